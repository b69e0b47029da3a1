"""Checked queries over the driver tables, grouped like the library."""


def load_checks():
    """Import every check module and return the registry in registration order."""
    from photospark.checks import registry
    import importlib

    for name in MODULES:
        importlib.import_module(f"photospark.checks.{name}")
    return registry.CHECKS


MODULES = ["view_checks", "label_checks", "eval_checks", "group_checks", "pixel_checks", "run_checks", "plan_checks"]
