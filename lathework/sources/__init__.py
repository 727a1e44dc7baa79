"""Where rows come from and go to: adapters, the catalog of tables, and the engine that runs queries."""

from .adapters import connect, find_dialect, find_driver, register, unregister
from .catalog import Catalog, Manifest
from .engine import Engine, EngineError, Options, Result

__all__ = ["Catalog", "Engine", "EngineError", "Manifest", "Options", "Result", "connect", "find_dialect", "find_driver", "register", "unregister"]
