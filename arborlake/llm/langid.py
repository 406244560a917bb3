"""Language identification by Bayesian fusion of independent pieces of evidence.

P(language | page) is taken proportional to P(text | language) * P(declared | language) * P(language | host).

- Text: a multinomial model of hashed byte trigrams, tempered because trigrams overlap, trained here on a bounded
  sample of rows by their declared language, in two folds, each judged by the other's. An extra class with equal trigram odds stands for no language.
- Declared: the markup's (or table's) language is right with a given reliability.
- Host: what the texts of a host's other pages say, smoothed towards those of its address suffix, those towards all:
  (own + strength * parent) / (pages + strength). All counts are sums of text posteriors by grouped
  aggregation; a row's own text is taken out of its counts, so no text speaks twice.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.linededup import html_lines
from arborlake.llm.text import positional, slices
from arborlake.llm.urlfilter import host_of
from arborlake.runtime import durable, small_side

NONE = "und"
_BUCKETS = 1 << 16
_PIECE = 1 << 20
#: Posteriors are counted in whole numbers of this part, so that sums do not depend on the order of rows.
_UNIT = 1 << 24


def _trigrams(text: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of all byte trigrams of the lower-cased text, in pieces."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    for at in range(0, len(b) - 2, _PIECE):
        p = b[at : at + _PIECE + 2]
        yield ((((p[:-2] << 16) | (p[1:-1] << 8) | p[2:]) * np.uint32(2654435761)) >> 16).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """Languages (the last is NONE) and log odds of each trigram bucket: folds x buckets x languages.

    A text is judged by the table that its own fold had no part in, so no row's label speaks through its own text.
    """

    languages: tuple[str, ...]
    tables: np.ndarray

    def score(self, text: bytes) -> np.ndarray:
        total = np.zeros(len(self.languages))
        if text.strip():
            table = self.tables[_fold(text)]
            for t in _trigrams(text):
                total += table[t].sum(axis=0, dtype=np.float64)
        return total


def _fold(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 11) & 1


def train(rows: list[tuple[str, str]], least: int = 10) -> TextModel:
    """A model from (language, text) rows; languages with fewer than ``least`` rows are left out (none, if all have fewer).

    The table for one fold is made of the rows of the other, or of all rows where a language has none there.
    """
    seen = Counter(language for language, _ in rows)
    names = sorted(x for x in seen if seen[x] >= least) or sorted(x for x, _ in seen.most_common(least))
    place = {x: i for i, x in enumerate(names)}
    counts = np.zeros((2, len(names), _BUCKETS))
    for language, text in rows:
        if language in place:
            data = text.encode()
            for t in _trigrams(data):
                counts[1 - _fold(data), place[language]] += np.bincount(t, minlength=_BUCKETS)
    alone = counts.sum(axis=2, keepdims=True) == 0
    counts = np.where(alone, counts.sum(axis=0, keepdims=True), counts)
    odds = np.log((counts + 0.1) / (counts.sum(axis=2, keepdims=True) + 0.1 * _BUCKETS))
    none = np.full((2, 1, _BUCKETS), -np.log(_BUCKETS))
    return TextModel((*names, NONE), np.concatenate([odds, none], axis=1).transpose(0, 2, 1).astype(np.float32))


def primary(tag: Column) -> Column:
    """A language tag's primary part, lower-cased; null if empty."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(tag), "^[A-Za-z]+", 0)), F.lit(""))


def markup_language(html: Column) -> Column:
    """The lang attribute of the html element, null without one."""
    return primary(F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1))


def training_sample(
    docs: DataFrame, text: Column, declared: Column, rows: int = 4000, longest: int = 20_000, floor: int = 60, tags: int = 200
) -> list[tuple[str, str]]:
    """About ``rows`` distinct (language, text) pairs, and about ``floor`` of each language that has as many, all of one that
    has fewer; in all twice the number wanted at most.

    Declared tags are free text, so only the ``tags`` most frequent ones count as languages (of equally frequent ones the
    first by name). Texts of at most ``longest`` bytes are drawn; a language with fewer than ``floor`` of those gives its
    longer texts too, cut to that length. Rows are drawn where they are read, by a hash of the text against the part wanted
    of their language, so the sample is the same however rows are partitioned.
    """
    some = docs.select(primary(declared).alias("language"), text.alias("text"))
    some = some.where(F.col("language").isNotNull() & (F.trim("text") != ""))
    short = F.octet_length("text") <= longest
    counts = some.groupBy("language").agg(F.count("*").alias("n"), F.count_if(short).alias("short"))
    counts = counts.orderBy(F.desc("n"), "language").limit(tags).collect()
    total = sum(r.short for r in counts)
    parts, wanted = [], 0.0
    for r in counts:
        n = r.short if r.short >= floor else r.n
        part = min(1.0, max(rows / max(1, total), floor / n))
        parts.append((r.language, int(part * (1 << 30)), r.short < floor))
        wanted += part * n
    if not parts:
        return []
    parts = F.broadcast(docs.sparkSession.createDataFrame(parts, "of string, part long, long boolean"))
    drawn = some.withColumn("at", F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 30))).join(parts, F.col("language") == F.col("of"))
    drawn = drawn.where((F.col("at") < F.col("part")) & (short | F.col("long")))
    cut = F.when(short, F.col("text")).otherwise(F.substring("text", 1, longest // 4))
    drawn = drawn.select("at", "language", cut.alias("text")).distinct()
    return [(r.language, r.text) for r in drawn.orderBy("at", "language", "text").limit(2 * math.ceil(wanted)).collect()]


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _sums(counts: DataFrame, n: int, *by: str) -> DataFrame:
    """``by``, n and c (an array of ``n`` sums) of hosts' counts. All are whole numbers, so their order does not matter."""
    each = [F.sum(F.get("c", F.lit(i))) for i in range(n)]
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.array(*each).alias("c"))


def _scored(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows`` with their last column, a text, replaced by its log odds ``ll``."""
    shared, keep = rows.sparkSession.sparkContext.broadcast(model), rows.columns[:-1]
    schema = rows.select(*keep, F.array(F.lit(0.0)).alias("ll")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            ll = [m.score((t.as_py() or "").encode()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ll, pa.list_(pa.float64()))], [*keep, "ll"])

    return rows.mapInArrow(run, schema)


#: Names of the columns that :func:`identify` appends.
FOUND = ("language", "confidence", "declared", "accepted")


def identify(
    docs: DataFrame, model: TextModel, text: Column, declared: Column, host: Column, suffix: Column, keep: list[str] | None = None,
    reliability: float = 0.9, strength: float = 10.0, temper: float = 0.3, least: float = 0.5,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with four more columns at the end: language, confidence, declared, accepted.

    text, declared, host, suffix: columns over ``docs``; null is no evidence (null hosts share one prior). A row is
    accepted if its likeliest language is one of the model's with at least ``least`` probability; of equally likely ones the
    first by name. Null and blank texts are no evidence of a language: they get NONE and are not accepted, whatever is declared.
    Repeated rows give repeated rows, an empty table an empty one. Columns of ``docs`` may have any names; where one has the
    name of an appended column, the result has both.

    Texts are scored once, where they are read; what is kept of a row is written with its scores, then joined with the
    priors of its host, by broadcast while these are measured to be small.
    """
    names = [i for i, c in enumerate(docs.columns) if keep is None or c in keep]
    k, n = len(names), len(model.languages)
    given = docs.select("*", primary(declared), F.coalesce(host, F.lit("")), F.coalesce(suffix, F.lit("")), text)
    plain, own_names = positional(given)
    kept, width = [own_names[i] for i in names], len(docs.columns)
    plain = plain.select(*kept, *own_names[width:]).toDF(*[f"k{i}" for i in range(k)], "said", "host", "suffix", "body")
    rows = durable(_scored(plain, model), "scores")

    blank = F.forall("ll", lambda x: x == 0)
    odds = F.transform("ll", lambda x: F.exp((x - F.array_max("ll")) * temper))
    share = F.transform(odds, lambda x: F.round(x / _total(odds) * _UNIT).cast("long"))
    own = F.when(blank, F.array_repeat(F.lit(0).cast("long"), n)).otherwise(share)
    rows = rows.withColumn("own", own)

    each = rows.select("host", "suffix", (~blank).cast("long").alias("n"), F.col("own").alias("c"))
    by_host = durable(_sums(each, n, "host", "suffix"), "hosts")
    root = _sums(by_host, n).first()
    root = [(x / _UNIT + 1.0) / (root.n + n) for x in root.c] if root.n is not None else [1.0 / n] * n
    smooth = F.zip_with("c", F.array(*map(F.lit, root)), lambda x, r: (x / _UNIT + r * strength) / (F.col("n") + strength))
    by_suffix = durable(_sums(by_host, n, "suffix").select(F.col("suffix").alias("of_suffix"), smooth.alias("parent")), "suffixes")
    hosts = by_host.join(small_side(by_suffix), F.col("suffix") == F.col("of_suffix"))
    hosts = durable(hosts.select(F.col("host").alias("h"), F.col("suffix").alias("s"), F.col("n").alias("pages"), "c", "parent"), "priors")

    both = rows.join(small_side(hosts), (F.col("host") == F.col("h")) & (F.col("suffix") == F.col("s")), "left")
    others = F.greatest(F.col("pages") - F.when(blank, 0).otherwise(1), F.lit(0))
    prior = lambda x: (F.greatest(x["c"] - x["own"], F.lit(0)) / _UNIT + strength * x["parent"]) / (others + strength)
    known, wrong = F.array(*map(F.lit, model.languages)), math.log((1 - reliability) / max(1, n - 1))
    silent = F.col("said").isNull() | ~F.array_contains(known, F.col("said"))
    said = lambda x: F.when(silent, 0.0).when(x == F.col("said"), math.log(reliability)).otherwise(wrong)
    evidence = F.arrays_zip("ll", "c", "parent", "own", known.alias("name"))
    logit = F.transform(evidence, lambda x: x["ll"] * temper + said(x["name"]) + F.log(prior(x)))
    both = both.withColumn("logit", logit)
    best = F.array_max("logit")
    language = F.when(blank, NONE).otherwise(F.element_at(known, F.array_position("logit", best).cast("int")))
    confidence = F.when(blank, 0.0).otherwise(1 / _total(F.transform("logit", lambda x: F.exp(x - best))))
    out = both.select(*[f"k{i}" for i in range(k)], language.alias("language"), confidence.alias("confidence"), "said")
    out = out.withColumn("accepted", (F.col("language") != NONE) & (F.col("confidence") >= least))
    return out.toDF(*[docs.columns[i] for i in names], *FOUND)


def document_languages(docs: DataFrame, **how) -> DataFrame:
    """:func:`identify` over the corpus table: ``lang`` is the declared language, ``source`` the host; no suffix is known."""
    text, declared = F.col("text"), F.col("lang")
    model = train(training_sample(docs, text, declared))
    return identify(docs, model, text, declared, F.col("source"), F.lit(None).cast("string"), **how)


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified, lang being that language; all columns, of any names, stay in place."""
    plain, names = positional(document_languages(docs))
    width = len(docs.columns)
    language, accepted = names[width], names[width + 3]
    out = [F.col(language if c == "lang" else names[i]).alias(names[i]) for i, c in enumerate(docs.columns)]
    return plain.where(F.col(accepted)).select(*out).toDF(*docs.columns)


def page_languages(pages: DataFrame, **how) -> DataFrame:
    """:func:`identify` over raw pages: the visible text, the markup's language, the url's host and its last label as suffix."""
    host = host_of(F.col("url"))
    suffix = F.regexp_extract(host, r"([^.:]*)(?::\d*)?$", 1)
    text, declared = F.array_join(html_lines(F.col("html")), "\n"), markup_language(F.col("html"))
    return identify(pages, train(training_sample(pages, text, declared)), text, declared, host, suffix, **how)
