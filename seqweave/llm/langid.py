"""Language identification by fusing evidence.

For each document, log-probabilities are added up over the languages (and ``und``, no language): of the text under
letter-trigram models, of the declared markup language and of the address suffix given the language, and of the language
at the host. Those of declarations, suffixes and hosts are counted over the whole corpus by grouped aggregation of what
the texts alone say; a host's counts are smoothed towards its parent's, and those towards all documents'.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

UND = "und"
#: Labelled rows of a language that its trigram model is fitted on at most, of all languages together (but 20 of each in
#: any case), languages that have models at most, and hash buckets of trigrams.
SAMPLE, SAMPLE_ALL, LANGUAGES, BUCKETS = 500, 20_000, 400, 1 << 16
#: What each bucket counts beforehand. A model of fewer trigrams than all buckets count so is hardly one: it is like UND.
BEFORE = 0.05
#: Trigrams of a text that count at most as independent evidence, trigrams for one such, prior weight of UND.
EFFECTIVE, OVERLAP, UND_PRIOR = 300, 3, 0.02
#: Strength of the smoothing, as a number of documents; share of wrong declarations that is taken for granted.
KAPPA, WRONG = 10.0, 0.05
CHUNK = 1 << 20
#: Bytes that are no letters become blanks.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Bucket numbers of a text's byte trigrams that hold a letter; letters in lower case, all else as blanks."""
    raw = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    if not raw:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


class Model:
    """Trigram log-probabilities of each language, and of UND, whose buckets are equally likely.

    ``found`` has the bucket counts of each language, ``bounds`` the highest hash of the rows they are from.
    """

    def __init__(self, found: dict[str, np.ndarray], bounds: dict[str, int] | None = None):
        self.languages = sorted(lang for lang, n in found.items() if n.sum() >= BEFORE * BUCKETS)
        counts = np.column_stack([found[lang] for lang in self.languages] or [np.zeros((BUCKETS, 0))]) + BEFORE
        self.table = np.hstack([np.log(counts / counts.sum(axis=0)), np.full((BUCKETS, 1), -math.log(BUCKETS))]).astype(np.float32)
        self.bounds = {x: h for x, h in (bounds or {}).items() if x in self.languages}
        self.languages.append(UND)

    def evidence(self, text: str | None) -> np.ndarray | None:
        """Log-likelihoods, with trigrams beyond EFFECTIVE only sharpening the mean; None without letters."""
        code = trigrams(text)
        if not len(code):
            return None
        total = sum(self.table[code[i : i + CHUNK]].sum(axis=0, dtype=np.float64) for i in range(0, len(code), CHUNK))
        return total / len(code) * min(len(code), EFFECTIVE) / OVERLAP


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag, in lower case."""
    return F.lower(F.regexp_extract(tag, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))


def _label(label: str) -> Column:
    return F.coalesce(F.nullif(primary(F.col(label)), F.lit("")), F.trim(label))


def _hash(key: str) -> Column:
    return F.xxhash64(F.col(key), F.lit(17))


def _counts(rows: DataFrame) -> dict[str, np.ndarray]:
    """Trigram counts of each label's texts, made where the rows are; to the driver comes an array for each label."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bucket, n = np.unique(trigrams(text.as_py()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], names=["label", "bucket", "n"])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(BUCKETS, np.float32)
        counts[frame["bucket"].to_numpy()] = frame["n"]
        return pd.DataFrame({"label": [frame["label"].iloc[0]], "counts": [counts.tobytes()]})

    sums = rows.mapInArrow(parts, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    return {r["label"]: np.frombuffer(r["counts"], np.float32).astype(float) for r in sums.groupBy("label").applyInPandas(whole, "label string, counts binary").collect()}


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of every language that labels name, each from at most ``sample`` rows, those with the lowest hashes of
    their keys.

    The languages are counted over all rows, so a rare one is fitted on what rows it has. Those with too little text for
    a model, and beyond the ``LANGUAGES`` most frequent, have none; ``identify`` doesn't reject what is declared as such.
    Labels that are language tags count by their primary subtag. Rows without label, text or key aren't used; with no
    rows left there are no languages but UND. Texts are counted whole, on the executors.
    """
    usable = docs.select(_label(label).alias("label"), _hash(key).alias("h"), F.col(key).alias("_key"), F.col(text).alias("text"))
    usable = usable.filter((F.col("label") != "") & (F.col("label") != UND) & F.col("_key").isNotNull() & F.col("text").isNotNull())
    counted = {r["label"]: r["count"] for r in usable.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect()}
    if not counted:
        return Model({})
    most = min(sample, max(20, SAMPLE_ALL // len(counted)))
    usable = usable.filter(F.col("label").isin(list(counted)))
    # The bounds come from thin rows, of frequent languages those with low hashes; the texts are read for what is within.
    likely = F.create_map(*(F.lit(x) for lang, n in counted.items() for x in (lang, -(1 << 63) + int((1 << 64) * min(1.0, 4 * most / n)) - 1)))

    def lowest(rows: DataFrame) -> dict[str, tuple[int, int]]:
        nth = F.row_number().over(Window.partitionBy("label").orderBy("h"))
        few = rows.select("label", "h").withColumn("nth", nth).filter(F.col("nth") <= most).groupBy("label").agg(F.max("h").alias("h"), F.count(F.lit(1)).alias("n"))
        return {r["label"]: (r["h"], r["n"]) for r in few.collect()}

    bounds = lowest(usable.filter(F.col("h") <= likely[F.col("label")]))
    if short := [lang for lang, n in counted.items() if bounds.get(lang, (0, 0))[1] < min(most, n)]:  # where keys repeat
        bounds |= lowest(usable.filter(F.col("label").isin(short)))
    bound = F.create_map(*(F.lit(x) for lang, (h, _) in bounds.items() for x in (lang, h)))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h", F.xxhash64("text")))
    rows = usable.filter(F.col("h") <= bound[F.col("label")]).withColumn("nth", nth).filter(F.col("nth") <= most).select("label", "text")
    return Model(_counts(rows), {lang: h for lang, (h, _) in bounds.items()})


def unseen(model: Model, key: str, label: str) -> Column:
    """The label where it is no row's that the model may be fitted on; so no label is evidence for what it was fitted to."""
    if not model.bounds:
        return F.col(label)
    bound = F.create_map(*(F.lit(x) for lang, h in model.bounds.items() for x in (lang, h)))
    return F.when(F.coalesce(_hash(key) > bound[_label(label)], F.lit(True)), F.col(label))


def identify(docs: DataFrame, model: Model, key: str, text: str, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, parent: Column | None = None, kappa: float = KAPPA, wrong: float = WRONG) -> DataFrame:
    """(key, language, probability, kept), a row for each document.

    ``declared`` is a language tag, ``suffix`` the end of an address, ``host`` and ``parent`` name where the document is
    from; each may be null or missing and is then no evidence. ``kept`` is false for documents without letters and for
    those that are most probably no language (UND). Where a language is declared that has no model, the text can't tell it
    from UND: it is that language then, and kept if it has letters. With a model without languages all are UND otherwise and
    kept if they have letters. Languages that are equally probable go by name, UND last. Null texts count as empty;
    repeated rows stay and count; an empty table gives no rows.
    """
    n = len(model.languages)
    null = F.lit(None).cast("string")

    @F.pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([None if (e := model.evidence(t)) is None else e.tolist() for t in texts], dtype=object)

    known = [x for x in model.languages if x != UND]
    tag = primary(declared) if declared is not None else null
    thin = docs.select(F.col(key).alias("_key"), F.when(tag.isin(known), tag).alias("declared") if known else null.alias("declared"), F.when((tag != "") & ~tag.isin([*known, UND]), tag).alias("unknown"), *((null if c is None else c).alias(name) for name, c in (("suffix", suffix), ("host", host), ("parent", parent))), evidence(F.col(text)).alias("e"))
    thin = materialize(thin, "evidence")
    prior = [math.log(UND_PRIOR if x == UND else (1 - UND_PRIOR) / max(1, n - 1)) for x in model.languages]
    e = [F.col("e")[i] for i in range(n)]

    def posterior(logs: list[Column]) -> list[Column]:
        top = F.greatest(*logs) if n > 1 else logs[0]
        scaled = [F.exp(x - top) for x in logs]
        total = sum(scaled[1:], scaled[0])
        return [x / total for x in scaled]

    alone = thin.filter("e is not null").select("declared", "suffix", "host", "parent", *(p.alias(f"p{i}") for i, p in enumerate(posterior([x + p for x, p in zip(e, prior, strict=True)]))))
    sums = [F.sum(f"p{i}").alias(f"s{i}") for i in range(n)]
    # Few rows: one for each suffix, declaration, host and parent, with a sum for each language.
    overall = alone.agg(*sums).first()
    total = sum(overall[i] or 0.0 for i in range(n))
    base = [((overall[i] or 0.0) + math.exp(prior[i])) / (total + 1) for i in range(n)]
    # Probability of a declaration given the language: what the corpus shows, smoothed towards few wrong declarations.
    says = {r["declared"]: [r[f"s{i}"] for i in range(n)] for r in alone.filter("declared is not null").groupBy("declared").agg(*sums).collect()}
    of_language = [sum(v[i] for v in says.values()) for i in range(n)]
    given = lambda d, i: math.log(((says[d][i] if d in says else 0.0) + kappa * ((1 - wrong) if d == model.languages[i] else wrong / max(1, len(known)))) / (of_language[i] + kappa))
    said = [F.lit(0.0)] * n
    for d in known:
        said = [F.when(F.col("declared") == d, given(d, i)).otherwise(said[i]) for i in range(n)]
    # Languages at a suffix, against those of all documents, as the likelihood of the suffix.
    smooth = lambda counts, towards: [(F.coalesce(c, F.lit(0.0)) + kappa * t) / (F.coalesce(sum(counts[1:], counts[0]), F.lit(0.0)) + kappa) for c, t in zip(counts, towards, strict=True)]
    cols = [F.col(f"s{i}") for i in range(n)]
    at_suffix = alone.filter("suffix is not null").groupBy("suffix").agg(*sums).select("suffix", F.array(*(F.log(x / b) for x, b in zip(smooth(cols, base), base, strict=True))).alias("suffix_log"))
    # Host counts towards parent counts towards all counts; hosts of no parent go straight to all.
    hosts = alone.filter("host is not null").groupBy("host", "parent").agg(*sums)
    if parent is not None:
        hosts = materialize(hosts, "hosts")
        above = materialize(hosts.filter("parent is not null").groupBy("parent").agg(*(F.sum(f"s{i}").alias(f"a{i}") for i in range(n))), "parents")
        hosts = hosts.join(small(above), "parent", "left")
    else:
        hosts = hosts.select("*", *(F.lit(None).cast("double").alias(f"a{i}") for i in range(n)))
    higher = smooth([F.col(f"a{i}") for i in range(n)], [F.lit(b) for b in base])
    at_host = hosts.select(F.col("host").alias("_host"), F.col("parent").alias("_parent"), F.array(*(F.log(x) for x in smooth(cols, higher))).alias("host_log"))
    out = thin
    if suffix is not None:
        out = out.join(small(materialize(at_suffix, "suffixes")), "suffix", "left")
    if host is not None:
        at_host = small(materialize(at_host, "hosts"))
        out = out.join(at_host, (F.col("host") == F.col("_host")) & F.col("parent").eqNullSafe(F.col("_parent")), "left")
    logs = [e[i] + said[i] + (F.coalesce(F.col("suffix_log")[i], F.lit(0.0)) if suffix is not None else 0.0) + (F.coalesce(F.col("host_log")[i], F.lit(math.log(base[i]))) if host is not None else F.lit(prior[i])) for i in range(n)]
    found = out.select("_key", "e", "unknown", F.array(*logs).alias("_l"))
    best = F.array_max("_l")
    language = F.when(F.col("e").isNull(), F.lit(UND)).otherwise(F.element_at(F.array(*(F.lit(x) for x in model.languages)), F.array_position("_l", best).cast("int")))
    probability = 1 / F.aggregate(F.transform("_l", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    language = F.when(F.col("e").isNotNull() & (language == UND), F.coalesce("unknown", language)).otherwise(language)
    kept = F.col("e").isNotNull() & (language != UND) if known else F.col("e").isNotNull()
    return found.select(F.col("_key").alias(key), language.alias("language"), F.when(F.col("e").isNotNull(), probability).alias("probability"), kept.alias("kept"))
