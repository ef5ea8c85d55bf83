"""Registered queries; importing this package fills the registry."""
import importlib
import pkgutil

for _package in (__name__, "tracewell.functions", "tracewell.streaming"):
    for _module in pkgutil.iter_modules(importlib.import_module(_package).__path__):
        importlib.import_module(f"{_package}.{_module.name}")
