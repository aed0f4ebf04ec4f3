"""Settings of a scan, from JSON."""

from __future__ import annotations

import json
import os
import re
import warnings
from dataclasses import dataclass, field, replace

from topograph.operators.risk import RiskWeights

# What a scan leaves out, and what counts as a test, by default.
IGNORE_DIRS = [".git", ".hg", ".svn", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".ruff", ".venv", "venv", "env", "ENV", "node_modules", "build", "dist", "target", ".idea", ".vscode", ".vs", ".eggs", "*.egg-info"]
IGNORE_FILES = ["*.pyc", "*.pyo", "*.so", "*.dll", "*.dylib", "*.exe", "*.min.js", "*.min.css", "*.lock", "package-lock.json", "yarn.lock", "poetry.lock", "pip-lock.json", "composer.lock"]
INCLUDE_DIRS = ["include", "src", "lib", "inc"]
TEST_PATTERNS = ["test_*.py", "*_test.py", "Test*.java", "*Test.java", "*Spec.kt", "*Tests.kt", "*.spec.js", "*.spec.ts", "*.spec.jsx", "*.spec.tsx", "*.test.js", "*.test.ts", "*.test.jsx", "*.test.tsx"]
TEST_DIRS = ["tests", "test", "spec", "src/test", "src/tests", "__tests__"]


@dataclass(frozen=True)
class Config:
    ignore_dirs: list[str] = field(default_factory=lambda: list(IGNORE_DIRS))
    ignore_files: list[str] = field(default_factory=lambda: list(IGNORE_FILES))
    include_dirs: list[str] = field(default_factory=lambda: list(INCLUDE_DIRS))
    test_patterns: list[str] = field(default_factory=lambda: list(TEST_PATTERNS))
    test_dirs: list[str] = field(default_factory=lambda: list(TEST_DIRS))
    max_file_size_kb: int = 512
    high_threshold: float = 70
    medium_threshold: float = 30
    weights: RiskWeights = RiskWeights()

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Lists that are given replace the defaults; text that isn't a JSON object leaves them all."""
        try:
            given = json.loads(text)
            if not isinstance(given, dict):
                raise ValueError("not an object")
        except ValueError as e:
            warnings.warn(f"configuration ignored: {e}", stacklevel=2)
            return cls()
        lists = {k: list(given[k]) for k in ("ignore_dirs", "ignore_files", "include_dirs", "test_patterns", "test_dirs") if isinstance(given.get(k), list)}
        risk = given.get("risk") or {}
        out = replace(cls(), **lists)
        return replace(out, high_threshold=risk.get("high_threshold", 70), medium_threshold=risk.get("medium_threshold", 30), weights=RiskWeights.from_dict(risk.get("weights") or {}))


def _object(path: str) -> dict:
    """A JSON object with comments and trailing commas, as script tools write them; an empty one if there is none."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError:
        return {}
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    try:
        found = json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", text))
    except ValueError as e:
        warnings.warn(f"{path} ignored: {e}", stacklevel=2)
        return {}
    return found if isinstance(found, dict) else {}


def script_aliases(root: str) -> dict[str, list[str]]:
    """The aliases of tsconfig.json, their targets seen from the root."""
    options = _object(os.path.join(root, "tsconfig.json")).get("compilerOptions") or {}
    base = str(options.get("baseUrl") or ".").removeprefix("./").strip("/")
    place = lambda t: "/".join(x for x in (base if base != "." else "", t.removeprefix("./")) if x)
    paths = options.get("paths") or {}
    return {alias: [place(t) for t in targets if isinstance(t, str)] for alias, targets in paths.items() if isinstance(targets, list)}


def script_exports(root: str) -> dict[str, str]:
    """What the package of package.json exports: the file of each name that other code may import."""
    spec = _object(os.path.join(root, "package.json"))
    name = spec.get("name")
    if not isinstance(name, str):
        return {}

    def file(entry: object) -> str | None:
        while isinstance(entry, dict):
            entry = next((entry[k] for k in ("import", "require", "default") if k in entry), None)
        return entry.removeprefix("./") if isinstance(entry, str) else None

    exports = spec.get("exports")
    if isinstance(exports, str) or isinstance(exports, dict) and not any(k.startswith(".") for k in exports):
        exports = {".": exports}
    found = {name + k.removeprefix("."): file(v) for k, v in (exports or {}).items() if "*" not in k}
    found.setdefault(name, file(spec.get("main")))
    return {k: v for k, v in found.items() if v}
