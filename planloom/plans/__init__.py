"""Registered queries. ``load_all`` imports every query module and returns the registry."""

import importlib
import pkgutil


def load_all():
    from planloom.plans import registry

    for info in pkgutil.iter_modules(__path__):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
    return registry
