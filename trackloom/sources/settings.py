"""Settings and registries: files merged, variables put in, overrides applied, everything checked against what is declared."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping
from dataclasses import MISSING, asdict, dataclass, field, fields

import yaml
from pyspark.sql import DataFrame, SparkSession

from trackloom.operators.products import select_names
from trackloom.sources import store

# ---- files and overrides ---------------------------------------------------

#: Sections that a later file replaces as a whole, as an arm's settings aren't another's.
WHOLE = ("model",)


def merged(below: Mapping, above: Mapping, top: bool = True) -> dict:
    """Settings of `above` over those of `below`, section by section."""
    deeper = lambda k: isinstance(below.get(k), Mapping) and isinstance(above[k], Mapping) and not (top and k in WHOLE)
    return {**below, **{k: merged(below[k], v, top=False) if deeper(k) else v for k, v in above.items()}}


def filled_in(value, env: Mapping[str, str] = os.environ):
    """${NAME} values from the environment; a name that isn't set raises."""
    if isinstance(value, Mapping):
        return {k: filled_in(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [filled_in(v, env) for v in value]
    if isinstance(value, str) and value[:2] == "${" and value[-1:] == "}":
        if value[2:-1] not in env:
            raise RuntimeError(f"the settings name the variable {value[2:-1]}, which isn't set")
        return env[value[2:-1]]
    return value


def spoken(text: str):
    """A value from a command line: truth values, numbers and JSON lists by their looks, all else as text."""
    try:
        said = json.loads(text.lower() if text.lower() in ("true", "false") else text)
    except json.JSONDecodeError:
        if text[:1] == "[" and text[-1:] == "]":
            raise
        try:
            return float(text)  # 1e-3, .5, inf
        except ValueError:
            return text
    return said if isinstance(said, (bool, int, float, list)) else text


def overridden(settings: Mapping, overrides: Iterable[str]) -> dict:
    """section.key=value texts over settings; a key that isn't there raises."""
    out = dict(settings)
    for text in overrides:
        where, equals, value = text.partition("=")
        if not equals:
            raise ValueError(f"{text!r} isn't key=value")
        *sections, last = where.split(".")
        change: dict = {last: spoken(value)}
        node = out
        for s in sections:
            node = node.get(s) if isinstance(node, Mapping) else None
        if not isinstance(node, Mapping) or last not in node:
            raise KeyError(f"no such setting: {where}")
        for s in reversed(sections):
            change = {s: change}
        out = merged(out, change, top=False)
    return out


def load(spark: SparkSession, base: str, arm: str | None = None, overrides: Iterable[str] = ()) -> dict:
    """Settings of a YAML file, under those of an arm's file, with variables and overrides; paths of any store."""
    out: dict = {}
    for path in filter(None, (base, arm)):
        if not store.exists(spark, path):
            raise FileNotFoundError(path)
        out = merged(out, yaml.safe_load(store.read_text(spark, path)) or {})
    return overridden(filled_in(out), overrides)


def typed(kind: type, said: Mapping | None, what: str = ""):
    """A dataclass from a mapping: unknown keys raise, missing ones take their default or raise, sections that are dataclasses are read alike."""
    said, known = dict(said or {}), {f.name: f for f in fields(kind)}
    if extra := sorted(set(said) - set(known)):
        raise ValueError(f"{what or kind.__name__}: unknown settings {extra}")
    need = [n for n, f in known.items() if f.default is MISSING and f.default_factory is MISSING and n not in said]
    if need:
        raise ValueError(f"{what or kind.__name__}: missing settings {need}")
    inner = {n: f.default_factory for n, f in known.items() if f.default_factory is not MISSING and hasattr(f.default_factory, "__dataclass_fields__")}
    return kind(**{n: typed(inner[n], v, n) if n in inner and isinstance(v, Mapping) else tuple(v) if isinstance(v, list) else v for n, v in said.items()})


# ---- sources and datasets --------------------------------------------------

# The words that a registry may use.
WORDS = {
    "cadence": ("static", "annual", "monthly", "daily", "subdaily", "composite"),
    "chunk_bucket": ("static", "year", "month", "day", "hour", "composite"),
    "kind": ("image", "image_collection"),
    "mode": ("fixed", "utm"),
    "reducers": ("first", "mean", "mode"),
    "destination": ("drive", "cloud_storage"),
}


@dataclass(frozen=True)
class Grid:
    mode: str
    res: tuple[float, float]
    crs: str | None = None
    origin: tuple[float, float] = (0.0, 0.0)
    verified: bool = False


@dataclass(frozen=True)
class Source:
    name: str
    asset: str
    kind: str
    cadence: str
    grid: Grid
    bands: tuple[str, ...] = ()
    tier: int = 3
    description: str = ""
    scale_m: float = 10.0
    composite_days: int = 0
    last_year: int | None = None
    scale_factors: Mapping[str, float] = field(default_factory=dict)
    derived: tuple[Mapping, ...] = ()
    focal: tuple[Mapping, ...] = ()
    terrain: tuple[str, ...] = ()
    post: tuple[Mapping, ...] = ()
    extra_images: Mapping[str, str] = field(default_factory=dict)
    extra_collections: Mapping[str, Mapping] = field(default_factory=dict)
    class_fractions: tuple[Mapping, ...] = ()
    temporal_rates: tuple[Mapping, ...] = ()
    qa: Mapping = field(default_factory=lambda: {"kind": "none", "params": {}})
    reducers: tuple[str, ...] = ("first",)
    categorical: tuple[str, ...] = ()
    chunk_bucket: str = "static"

    def columns(self) -> list[str]:
        """What the source's export holds: bands, then what is made of them, in the order of declaration."""
        named = lambda group: [x["name"] for x in group if "name" in x]
        others = [f"{k}_{b}" for k, v in self.extra_collections.items() for b in v.get("bands", [])]
        relief = [t for t in self.terrain if t != "hillshade"]  # computed, never exported
        return [*self.bands, *named(self.derived), *named(self.focal), *relief, *named(self.post), *self.extra_images, *others, *named(self.class_fractions), *named(self.temporal_rates)]

    def faults(self) -> list[str]:
        """What is wrong with it; nothing where it is right."""
        by_word = [(w, getattr(self, w)) for w in ("cadence", "chunk_bucket", "kind")] + [("mode", self.grid.mode)] + [("reducers", r) for r in self.reducers]
        made = {*self.bands, *(x["name"] for x in self.derived)}
        rules = [
            *((v in WORDS[w], f"{w} {v!r} isn't one of {WORDS[w]}") for w, v in by_word),
            (self.grid.mode != "fixed" or self.grid.crs, "a fixed grid needs its crs"),
            (self.cadence != "composite" or self.composite_days, "a composite needs composite_days"),
            (self.cadence != "annual" or self.last_year, "an annual source needs last_year"),
            ("first" in self.reducers, "reducers lack 'first', the value at the point"),
            (all({"name", "band", "classes"} <= set(c) for c in self.class_fractions), "a class fraction needs name, band and classes"),
            (not self.temporal_rates or self.cadence == "composite", "rates need a composite cadence"),
            (all(r.get("band") in made for r in self.temporal_rates), "a rate is of a band that is neither native nor derived"),
            (all(int(r.get("lag_windows", 1)) >= 1 for r in self.temporal_rates), "a rate's lag_windows is at least 1"),
        ]
        return [said for right, said in rules if not right]


@dataclass(frozen=True)
class Dataset:
    name: str
    csv: str
    fixes: int
    duplicate_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Registry:
    export: Mapping
    datasets: Mapping[str, Dataset]
    sources: Mapping[str, Source]
    barred: frozenset[str] = frozenset()

    def dataset(self, name: str) -> Dataset:
        """One that is barred raises ValueError, one that is unknown KeyError."""
        if name in self.barred:
            raise ValueError(f"the dataset {name} is out of scope")
        return _named(self.datasets, name, "dataset")

    def source(self, name: str) -> Source:
        return _named(self.sources, name, "source")

    def select(self, spec: str | None) -> list[str]:
        """Names of sources by all, tierN and names, mixed by commas."""
        return select_names({n: s.tier for n, s in self.sources.items()}, spec)

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each source; registries have tens of them."""
        rows = [(n, s.tier, s.cadence, s.kind, float(s.scale_m), s.columns(), list(s.reducers)) for n, s in self.sources.items()]
        return spark.createDataFrame(rows, "source string, tier long, cadence string, kind string, scale_m double, columns array<string>, reducers array<string>")


def _named(known: Mapping, name: str, what: str):
    if name not in known:
        raise KeyError(f"no {what} {name!r} among {sorted(known)}")
    return known[name]


def registry(said: Mapping, barred: Iterable[str] = ()) -> Registry:
    """A registry from its mapping; all faults of all sources are named at once."""
    if lacks := [k for k in ("export", "datasets", "sources") if k not in said]:
        raise ValueError(f"the registry lacks {lacks}")
    if (to := said["export"].get("destination", "cloud_storage")) not in WORDS["destination"]:
        raise ValueError(f"destination {to!r} isn't one of {WORDS['destination']}")
    sources = {}
    for name, s in said["sources"].items():
        if "grid" not in s:
            raise ValueError(f"{name}: missing settings ['grid']")
        sources[name] = typed(Source, {**s, "name": name, "grid": typed(Grid, s["grid"], f"{name}.grid")}, name)
    if faults := [f"{n}: {f}" for n, s in sources.items() for f in s.faults()]:
        raise ValueError("; ".join(faults))
    return Registry(said["export"], {n: typed(Dataset, {**d, "name": n}, n) for n, d in said["datasets"].items()}, sources, frozenset(barred))


def read_registry(spark: SparkSession, path: str, barred: Iterable[str] = ()) -> Registry:
    return registry(yaml.safe_load(store.read_text(spark, path)) or {}, barred)


# ---- folders of runs -------------------------------------------------------


def write_run(spark: SparkSession, folder: str, settings: Mapping, manifest: Mapping | None = None) -> None:
    """config.yaml and manifest.json of a run."""
    store.write_text(spark, f"{folder}/config.yaml", yaml.safe_dump(json.loads(json.dumps(settings, default=lambda o: asdict(o))), sort_keys=False))
    store.write_text(spark, f"{folder}/manifest.json", json.dumps(dict(manifest or {}), indent=2))


def write_evaluation(folder: str, report: DataFrame, horizon: DataFrame, windows: DataFrame, model: str, split: str) -> None:
    """metrics.json of the one-row report, per_horizon.csv of some steps; per_window.csv is a folder of part files, as windows grow with the data."""
    spark = report.sparkSession
    out = {**report.first().asDict(recursive=True), "per_window_file": "per_window.csv", "per_horizon_file": "per_horizon.csv", "model": model, "split": split}
    store.write_text(spark, f"{folder}/metrics.json", json.dumps(out, indent=2))
    steps = horizon.orderBy("step").collect()  # one row a step of the horizon
    store.write_text(spark, f"{folder}/per_horizon.csv", "".join(",".join("" if v is None else str(v) for v in r) + "\n" for r in [tuple(horizon.columns), *steps]))
    windows.write.mode("overwrite").csv(f"{folder}/per_window.csv", header=True)


def markdown(rows: DataFrame, digits: int = 4, most: int = 1000) -> str:
    """A table of a report, in the rows' order. Reports are of units and arms: over `most` rows raise."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of over {most} rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows.columns, ["---"] * len(rows.columns), *([show(v) for v in r] for r in got)]) + "\n"


def chunk_outputs(spark: SparkSession, folder: str, chunk_id: str) -> list[str]:
    """Files of a completed chunk in any store; none raises."""
    found = store.matching(spark, f"{folder.rstrip('/')}/*{chunk_id}*")
    if not found:
        raise FileNotFoundError(f"no output of chunk {chunk_id} in {folder}")
    return found
