"""Pipelines of stages, each written when done, and the configuration that they are built from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run_stages(spark: SparkSession, folder: str, stages: list[tuple[str, Stage]], stop_after: str | None = None, rerun: str | None = None, least_rows: dict[str, int] | None = None, piped: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Run the stages in order and return their tables.

    A stage whose table was written completely is read, until the first that wasn't (or ``rerun``): from there on all are
    run again. A stage with fewer rows than ``least_rows`` asks for fails. Those named in ``piped`` aren't written but
    computed within the stages that read them: less disk, more work where several do.
    """
    done: dict[str, DataFrame] = {}
    fresh = False
    for name, stage in stages:
        path = f"{folder}/{name}"
        if name in piped:
            done[name] = stage(spark, done)
            if name == stop_after:
                break
            continue
        fresh = fresh or name == rerun or not _exists(spark, f"{path}/_SUCCESS")
        if fresh:
            stage(spark, done).write.mode("overwrite").parquet(path)
        done[name] = spark.read.parquet(path)
        if least_rows and name in least_rows and done[name].limit(least_rows[name]).count() < least_rows[name]:
            raise RuntimeError(f"stage {name} has fewer than {least_rows[name]} rows")
        if name == stop_after:
            break
    return done


@dataclass
class Config:
    """Sections of ``KEY = value`` lines: PATHS, DATA (one library a line) and PARAMETERS."""

    paths: dict[str, str] = field(default_factory=dict)
    libraries: list[dict] = field(default_factory=list)
    parameters: dict[str, str] = field(default_factory=lambda: {"GRAPH_KMER_SIZE": "auto", "KMER_COUNT_THRESHOLD": "1", "LIMIT_JUMP_COVERAGE": "60", "USE_LINKING_MATES": "1", "CLOSE_GAPS": "1", "JF_SIZE": "100000000"})

    @classmethod
    def parse(cls, text: str) -> Config:
        out, section = cls(), None
        for number, line in enumerate(text.splitlines(), 1):
            line = line.split("#")[0].strip()
            if not line:
                continue
            if line in ("PATHS", "DATA", "PARAMETERS"):
                section = line
                continue
            if line == "END":
                section = None
                continue
            key, sep, value = (x.strip() for x in line.partition("="))
            if section is None or not sep:
                raise ValueError(f"line {number}: {line!r} is in no section or has no value")
            if section == "PATHS":
                out.paths[key] = value
            elif section == "PARAMETERS":
                out.parameters[key] = value
            elif key in ("PE", "JUMP"):
                prefix, mean, stdev, *files = value.split()
                if len(prefix) != 2 or not files:
                    raise ValueError(f"line {number}: a library has a prefix of two letters, mean, stdev and files")
                out.libraries.append({"kind": key, "prefix": prefix, "mean": float(mean), "stdev": float(stdev), "files": files})
            elif key == "OTHER":
                out.libraries.append({"kind": key, "files": value.split()})
            else:
                raise ValueError(f"line {number}: {key} is no kind of data")
        prefixes = [x["prefix"] for x in out.libraries if "prefix" in x]
        if len(set(prefixes)) < len(prefixes):
            raise ValueError("two libraries have the same prefix")
        if not any(x["kind"] == "PE" for x in out.libraries):
            raise ValueError("at least one PE library is needed")
        for key in ("KMER_COUNT_THRESHOLD", "LIMIT_JUMP_COVERAGE", "CLOSE_GAPS", "USE_LINKING_MATES"):
            if not out.parameters[key].isdigit():
                raise ValueError(f"{key} must be a number")
        return out
