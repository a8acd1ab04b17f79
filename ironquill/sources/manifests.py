"""Package manifests -> declared packages.

Input: manifests (``repo, path, manifest, content``).  A parser is a column
function from the text to an array of (name, version) in file order, so one
scan of the manifests serves all formats.  *Declared* rows are ``repo, path,
manifest, pos, name, version``; what cannot be parsed yields no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import jvm
from ..functions.text import first_match, strip, unify_newlines

KEYS = ("repo", "path", "manifest")
PACKAGES = "array<struct<name:string,version:string>>"
JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true", "mode": "PERMISSIVE"}
_PIN = jvm(r"^([A-Za-z0-9_.\-]+)\s*([=<>~!]{1,2})\s*([0-9][A-Za-z0-9.\-]*)")
_NAME = jvm(r"^([A-Za-z0-9_.\-]+)")
_PIPFILE_LINE = jvm(r'^([A-Za-z0-9_.\-]+)\s*=\s*"([^"]*)"')
_LINE_ENDS = r"[\n\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _package(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _named(packages: Column) -> Column:
    return F.filter(packages, lambda p: p["name"] != "")


def _pinned(packages: Column) -> Column:
    return F.filter(packages, lambda p: (p["name"] != "") & (p["version"] != ""))


def _dashed(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def requirements(text: Column) -> Column:
    lines = F.filter(
        F.transform(F.split(unify_newlines(text), "\n"), strip),
        lambda ln: (ln != "") & ~F.startswith(ln, F.lit("#")) & ~F.startswith(ln, F.lit("-")))

    def package(ln):
        pinned = F.regexp_extract(ln, _PIN, 1)
        name = F.when(pinned != "", pinned).otherwise(F.regexp_extract(ln, _NAME, 1))
        return _package(_dashed(name), F.regexp_extract(ln, _PIN, 3))

    return _named(F.transform(lines, package))


def _member(text: Column, name: str) -> Column:
    """A top-level member of a JSON document, as JSON text."""
    return F.from_json(text, f"`{name}` string", JSON_OPTIONS)[name]


def _is_object(raw: Column) -> Column:
    return F.startswith(F.ltrim(raw), F.lit("{"))


def _is_empty(raw: Column) -> Column:
    """Absent, null, false, zero or empty."""
    bare = F.regexp_replace(raw, r"\s+", "")
    return raw.isNull() | bare.isin("null", "false", "0", "0.0", "[]", "{}", '""', "")


def _entries(raw: Column, value: str) -> Column:
    kind = f"array<struct<key:string,value:{value}>>"
    parsed = F.map_entries(F.from_json(raw, f"map<string,{value}>", JSON_OPTIONS))
    return F.coalesce(F.when(_is_object(raw), parsed), F.array().cast(kind))


def _two_sections(text: Column, first: str, second: str, value: str) -> Column:
    """Entries of two members in turn; reading ends at one that is no object."""
    one, two = _member(text, first), _member(text, second)
    readable = _is_object(one) | _is_empty(one)
    return F.when(readable, F.concat(_entries(one, value), _entries(two, value))).otherwise(_entries(one, value))


def package_json(text: Column) -> Column:
    return F.transform(_two_sections(text, "dependencies", "devDependencies", "string"), lambda e: _package(
        F.lower(e["key"]), F.regexp_replace(F.coalesce(e["value"], F.lit("None")), jvm(r"^[\^~>=<\s]+"), "")))


def pipfile_lock(text: Column) -> Column:
    entries = _two_sections(text, "default", "develop", "struct<version:string>")
    return _pinned(F.transform(entries, lambda e: _package(
        F.lower(e["key"]), F.ltrim(e["value"]["version"], F.lit("=")))))


def flat_lock(text: Column) -> Column:
    """Lock formats 2 and 3: keys are installation paths."""
    entries = F.filter(_entries(_member(text, "packages"), "struct<version:string>"),
                       lambda e: F.contains(e["key"], F.lit("node_modules/")))
    return _pinned(F.transform(entries, lambda e: _package(
        F.lower(F.substring_index(e["key"], "node_modules/", -1)), e["value"]["version"])))


def nested_lock_udf():
    """Arrow UDF for lock format 1, whose sections nest to any depth."""
    @F.pandas_udf(PACKAGES)
    def walk(raws: pd.Series) -> pd.Series:
        import json

        def pairs(raw):
            found, stack = [], []
            try:
                stack.append(iter((json.loads(raw) or {}).items()) if raw else iter(()))
                while stack:
                    for name, info in stack[-1]:
                        if info.get("version", ""):
                            found.append({"name": name.lower(), "version": str(info["version"])})
                        if "dependencies" in info:
                            stack.append(iter((info["dependencies"] or {}).items()))
                            break
                    else:
                        stack.pop()
            except (ValueError, AttributeError):
                pass  # what was read before the fault is kept
            return found

        return raws.map(pairs)

    return walk


def pipfile(text: Column) -> Column:
    text = unify_newlines(text)
    blocks = [F.split(F.regexp_extract(text, rf"(?s)\[{s}\](.*?)(\n\[|\z)", 1), _LINE_ENDS)
              for s in ("packages", "dev-packages")]

    def package(raw):
        ln = strip(raw)
        version = F.ltrim(F.regexp_extract(ln, _PIPFILE_LINE, 2), F.lit("=~^<>"))
        return _package(_dashed(F.regexp_extract(ln, _PIPFILE_LINE, 1)),
                        F.when(version == "*", "").otherwise(version))

    return _named(F.transform(F.concat(*blocks), package))


def poetry_lock(text: Column) -> Column:
    blocks = F.split(unify_newlines(text), r"\[\[package\]\]")
    return _pinned(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), lambda b: _package(
        F.lower(F.regexp_extract(b, r'(?dm)^name\s*=\s*"([^"]+)"', 1)),
        F.regexp_extract(b, r'(?dm)^version\s*=\s*"([^"]+)"', 1))))


_PARSERS = {
    "poetry.lock": poetry_lock, "Pipfile.lock": pipfile_lock, "requirements.txt": requirements,
    "package.json": package_json, "Pipfile": pipfile,
}
_LOCK = "package-lock.json"


def declared_packages(manifests: DataFrame, only: str | None = None) -> DataFrame:
    """Packages of all manifests (or of one kind) from a single scan."""
    text, manifest = F.col("content"), F.col("manifest")
    chosen = manifests.filter(text.isNotNull() & (manifest == only if only else F.lit(True)))
    cases = [(manifest == m, parse(text)) for m, parse in _PARSERS.items() if only in (None, m)]
    if only in (None, _LOCK):
        old = (manifest == _LOCK) & _is_empty(_member(text, "packages"))
        chosen = chosen.withColumn("_old", F.when(old, _member(text, "dependencies"))).withColumn(
            "_nested", nested_lock_udf()("_old"))
        cases.insert(0, (manifest == _LOCK, F.concat(flat_lock(text), _pinned(F.col("_nested")))))
    return chosen.select(
        *KEYS, F.posexplode(first_match(cases, F.lit(None).cast(PACKAGES))).alias("pos", "_p")).select(
        *KEYS, "pos", "_p.name", "_p.version")


def src_requirements(manifests: DataFrame) -> DataFrame:
    return declared_packages(manifests, "requirements.txt")


def src_package_json(manifests: DataFrame) -> DataFrame:
    return declared_packages(manifests, "package.json")


def src_package_lock(manifests: DataFrame) -> DataFrame:
    return declared_packages(manifests, _LOCK)


def src_pipfile_lock(manifests: DataFrame) -> DataFrame:
    return declared_packages(manifests, "Pipfile.lock")


def src_pipfile(manifests: DataFrame) -> DataFrame:
    return declared_packages(manifests, "Pipfile")


def src_poetry_lock(manifests: DataFrame) -> DataFrame:
    return declared_packages(manifests, "poetry.lock")
