"""Experiment files: flat YAML, checked."""

from __future__ import annotations

import ast
import os
import re

# What a task, a fusion and a loss may be.
TASKS = ("application8", "tor_binary")
FUSIONS = ("gated", "concat", "fixed", "micro_only", "burst_only")
LOSSES = ("cross_entropy", "focal")
REQUIRED = ("experiment_id", "task", "fusion", "loss", "features_dir", "split_file")


def scalar(text: str):
    words = {"true": True, "false": False, "null": None, "none": None, "~": None, "": None}
    text = text.strip()
    if text.lower() in words:
        return words[text.lower()]
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text.strip("'\"")


def parse(text: str) -> dict:
    """A YAML mapping: by the yaml library where there is one, or else of lines `key: value`."""
    try:
        import yaml
    except ImportError:
        out = {}
        for number, line in enumerate(text.splitlines(), 1):
            line = re.sub(r"(^|\s)#.*$", "", line).strip()
            if not line:
                continue
            key, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"line {number} is no `key: value`: {line}")
            out[key.strip()] = scalar(value)
        return out
    got = yaml.safe_load(text)
    if not isinstance(got, dict):
        raise ValueError("an experiment file must be a mapping")
    return got


def check(values: dict, root: str = ".") -> dict:
    """The values with defaults, and paths below `root`; raises ValueError for what can't be run."""
    missing = [k for k in REQUIRED if k not in values]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    out = {"seed": 42, "feature_id": "unspecified", "split_id": "unspecified"} | values
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", str(out["experiment_id"])):
        raise ValueError("experiment_id may have letters, digits, dots, lines and hyphens only")
    for key, allowed in (("task", TASKS), ("fusion", FUSIONS), ("loss", LOSSES)):
        if out[key] not in allowed:
            raise ValueError(f"{key} must be one of {', '.join(allowed)}")
    for key in ("features_dir", "split_file"):
        if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", str(out[key])):
            out[key] = os.path.join(os.path.abspath(root), str(out[key]))
    return out | {"seed": int(out["seed"])}


def load(path: str, root: str | None = None) -> dict:
    with open(path, encoding="utf-8") as f:
        return check(parse(f.read()), root or os.path.dirname(os.path.abspath(path)))
