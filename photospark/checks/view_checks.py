"""Input shapes agree in both engines (they feed every other check)."""

from photospark.checks.registry import check


def _plain(name, columns, doubles=""):
    check(f"view_{name}", f"SELECT {columns} FROM {name}", views=name, doubles=doubles)(
        lambda v: getattr(v, name).selectExpr(*[c.strip() for c in columns.split(",")])
    )


_plain("hashes", "id, d, p")
_plain("pixels", "photo, y, x, r, g, b")
_plain("scores", "photo, view, family, label, score", "score")
_plain("edit_history", "id, name, recorded")
_plain("settings_text", "o_orderkey, settings")
_plain("split_of", "photo, split")
_plain("features4", "photo, x0, x1, x2, x3", "x0 x1 x2 x3")
