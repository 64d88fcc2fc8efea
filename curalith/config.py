"""Settings of a run from defaults, the environment, and the command line, each over the one before; and its log."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import os
import sys
import typing

PREFIX = "CURALITH_"


@dataclasses.dataclass
class Settings:
    """What a curation run asks for."""

    real_dir: str = ""
    synthetic_dir: str = ""
    save_dir: str = "out"
    seed: int = 42
    test_size: float = 0.30
    tries: int = 200
    hamming: int = 5
    tau_start: float = 0.90
    tau_step: float = 0.02
    tau_max: float = 0.98
    max_group_share: float = 0.02
    real_fraction: float = 1.0
    synthetic_fraction: float = 1.0
    strict: bool = True
    auto_resolve: bool = True
    frozen_real: str = ""
    frozen_synthetic: str = ""

    def __post_init__(self) -> None:
        for name in ("real_fraction", "synthetic_fraction"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} lies above 0 and is 1 at most")
        if not 0 < self.test_size < 1:
            raise ValueError("test_size lies between 0 and 1")


def _value(kind: type, text: str):
    if kind is bool:
        if text.lower() in ("1", "true", "yes", "on"):
            return True
        if text.lower() in ("0", "false", "no", "off", ""):
            return False
        raise ValueError(f"neither true nor false: {text}")
    return kind(text)


def settings(args: list[str] | None = None, env: typing.Mapping[str, str] | None = None) -> Settings:
    """Defaults, then variables such as CURALITH_SEED, then options such as --seed or --no-strict."""
    env = os.environ if env is None else env
    kinds = typing.get_type_hints(Settings)
    values = {n: _value(k, env[PREFIX + n.upper()]) for n, k in kinds.items() if PREFIX + n.upper() in env}
    parser = argparse.ArgumentParser(allow_abbrev=False)
    for n, k in kinds.items():
        option = "--" + n.replace("_", "-")
        if k is bool:
            parser.add_argument(option, action=argparse.BooleanOptionalAction, default=None)
        else:
            parser.add_argument(option, type=k, default=None)
    given = parser.parse_args(sys.argv[1:] if args is None else args)
    values |= {n: v for n, v in vars(given).items() if v is not None}
    return Settings(**values)


def log_to(path: str | None = None, name: str = "curalith") -> logging.Logger:
    """A logger to the console and, if given, a file on the driver; called again it replaces its handlers."""
    logger = logging.getLogger(name)
    for h in list(logger.handlers):
        logger.removeHandler(h)
        h.close()
    logger.setLevel(logging.INFO)
    form = logging.Formatter("%(asctime)s | %(levelname)s | %(message)s")
    for handler in [logging.StreamHandler(sys.stdout), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        handler.setFormatter(form)
        logger.addHandler(handler)
    return logger
