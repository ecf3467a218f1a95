"""The stages as files in a project folder, each skipped if nothing it depends on has changed."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tagloom import config
from tagloom.operators import combos, demultiplex as dm, hopping, similarity, statistics
from tagloom.sources import records, tables

log = logging.getLogger("tagloom")


class Project:
    """data/<stage>.parquet, stats/<stage>_statistics.json, data/pvalues.csv and a manifest of what made them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        for d in ("data", "stats", "tmp"):
            (self.root / d).mkdir(parents=True, exist_ok=True)

    def data(self, stage: str) -> str:
        return str(self.root / "data" / f"{stage}.parquet")

    def stats(self, stage: str) -> str:
        return str(self.root / "stats" / f"{stage}_statistics.json")

    def _run(self, stage: str, settings: dict, inputs: list[str], make: Callable[[], None], out: str) -> None:
        """make() unless the manifest has this stage with the same settings and input files (time and size)."""
        seen = {p: _stamp(p) for p in inputs}
        key = hashlib.sha256(json.dumps([settings, seen], sort_keys=True, default=str).encode()).hexdigest()
        note = self.root / "tmp" / f"{stage}.json"
        if note.exists() and Path(out).exists() and json.loads(note.read_text())["key"] == key:
            log.info("%s: up to date", stage)
            return
        log.info("%s: %s", stage, settings)
        note.unlink(missing_ok=True)
        make()
        note.write_text(json.dumps({"key": key}))

    def demultiplex(self, input_file: str, regex_file: str, barcode_file: str) -> None:
        groups, regexes, hierarchy = config.read_inputs(input_file), config.read_regexes(regex_file), config.read_hierarchy(barcode_file)
        config.check_regexes(hierarchy, regexes, groups)

        def make() -> None:
            raw, failed = [], []
            for g, files in groups.items():
                files = [config.InputFile(_beside(f.path, input_file), f.group, f.prefix) for f in files]
                patterns = regexes.of(g)
                c, s = dm.demultiplex(records.open_reads(self.spark, files, list(patterns)), hierarchy, patterns)
                raw.append(c)
                failed.append(s)
            out = combos.combine(raw)
            tables.write_parquet(out, self.data("demultiplex"))
            if self.spark.read.parquet(self.data("demultiplex")).isEmpty():
                raise ValueError("no read matches")
            rows = records.union_groups(failed).groupBy("kind", "barcode", "value").sum("reads").collect()  # reasons and reference names
            tables.write_json([list(r) for r in rows], self.stats("demultiplex"))

        inputs = [input_file, regex_file, barcode_file, *[_beside(f.path, input_file) for fs in groups.values() for f in fs]]
        self._run("demultiplex", {"hierarchy": [asdict(b) for b in hierarchy], "regexes": regexes.groups}, inputs, make, self.data("demultiplex"))

    def _between(self, stage: str, source: str, settings: dict, inputs: list[str], change: Callable[[DataFrame], DataFrame]) -> None:
        def make() -> None:
            before = tables.read_table(self.spark, source)
            tables.write_parquet(change(before), self.data(stage))
            a, b = (combos.totals(d).first() for d in (before, tables.read_table(self.spark, self.data(stage))))
            tables.write_json({"lids_before": a[0], "lids_after": b[0], "reads_before": a[1], "reads_after": b[1]}, self.stats(stage))

        self._run(stage, settings, [source, *inputs], make, self.data(stage))

    def error_correct(self, barcode_file: str, k: int = 1, remove_ambiguous: bool = False) -> None:
        hierarchy = config.read_hierarchy(barcode_file)
        self._between("error_correct", self.data("demultiplex"), {"k": k, "remove_ambiguous": remove_ambiguous}, [barcode_file], lambda d: similarity.error_correct(d, hierarchy, k, remove_ambiguous))

    def hopping_removal(self, sets: list[list[str]], alpha: float = 0.05) -> None:
        self._between("hopping_removal", self.data("error_correct"), {"sets": sets, "alpha": alpha}, [], lambda d: hopping.hopping_removal(d, sets, alpha))

    def threshold(self, threshold_file: str) -> None:
        self._between("threshold", self.data("hopping_removal"), {}, [threshold_file], lambda d: combos.threshold(d, tables.read_table(self.spark, threshold_file)))

    def pvalue(self, category_file: str, read_file: str | None = None, column: str = "reads", group_by: tuple[str, ...] = ("grna",), draws: int = 1_000_000, max_n: int = 950, seed: int = 0) -> None:
        source, out = read_file or self.data("threshold"), str(self.root / "data" / "pvalues.csv")

        def make() -> None:
            categories = tables.read_table(self.spark, category_file)
            categories = categories.select(*[c for c in categories.columns if c == "category" or c in group_by])
            d = statistics.with_category(tables.read_table(self.spark, source), categories)
            found = statistics.pvalues(d, column, group_by, draws, max_n, seed)
            tables.write_csv(statistics.category_results(found, categories), out)

        self._run("pvalue", {"column": column, "group_by": group_by, "draws": draws, "max_n": max_n, "seed": seed}, [source, category_file], make, out)


def _beside(path: str, file: str) -> str:
    p = Path(path)
    return path if "://" in path or p.is_absolute() or p.exists() else str(Path(file).parent / p)


def _stamp(path: str) -> list:
    p = Path(path)
    files = sorted(x for x in p.rglob("*") if x.is_file() and not x.name.startswith(".")) if p.is_dir() else [p] if p.exists() else []
    return [[x.name, x.stat().st_mtime_ns, x.stat().st_size] for x in files]
