"""Language of a text by Bayesian fusion of independent evidence.

    log P(language | all) = text + declared language + address suffix + host, up to a constant

* text: byte trigrams under a model per language, fitted on a bounded sample of the rows that
  declare it; languages are those that enough of all rows declare. The mean log-likelihood counts
  as EVIDENCE_GRAMS grams at most, since grams are not independent. A background, under which all
  trigrams are alike, stands for languages that are not known.
* declared language and address suffix: P(declared | language) and P(suffix | language), from
  grouped sums of the text's own posteriors over all rows, with a pseudo-count.
* host: a prior per host, smoothed towards its domain, which is smoothed towards all rows. The
  sums of a host and of its domain leave out the row itself, so no row is its own evidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utilscope.llm.shingles import CHUNK_BYTES, utf8
from utilscope.llm.storage import maybe_in, materialize, splittable, stored

BUCKETS = 1 << 14
#: Rows that a language takes into the sample at least, if it has them.
LEAST_SAMPLE = 50


@dataclass(frozen=True)
class Settings:
    """`sample_rows` bounds the rows that fit the text model (about), shared evenly among the languages.

    A language needs `least_rows` declared rows of the table, and takes as many into the sample at least.
    """

    sample_rows: int = 4000
    least_rows: int = 5
    evidence_grams: int = 40
    #: Rows that a domain's (or all rows') distribution counts against a host's own (a domain's).
    strength: float = 5.0
    #: Pseudo-count of a declaration or suffix.
    pseudo: float = 0.5
    #: A row is rejected when no language reaches this, or when its text has no letter.
    least_probability: float = 0.5
    #: Prior probability of a text unlike all languages.
    background: float = 0.001
    #: Size that the text model, which every worker gets, must not exceed: 2,048 languages at 128 KB each.
    most_model_bytes: int = 1 << 28


def _letters() -> np.ndarray:
    table = np.zeros(256, np.uint32)
    for b in range(256):
        c = chr(b)
        table[b] = 0x20 if b < 128 and not c.isalpha() else ord(c.lower()) if b < 128 else b
    return table


_LETTERS = _letters()


def _grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the letter trigrams of consecutive rows; grams of spaces alone are left out."""
    mapped = _LETTERS[data]
    if len(mapped) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (mapped[:-2] << np.uint32(16)) | (mapped[1:-1] << np.uint32(8)) | mapped[2:]
    blank = mapped == 0x20
    use = ~(blank[:-1] & blank[1:])
    use = use[:-1] & use[1:]
    for cross in (1, 2):  # grams across two rows
        edge = starts[1:-1] - cross
        use[edge[(edge >= 0) & (edge < len(use))]] = False
    at = np.flatnonzero(use)
    bucket = (code[at] * np.uint32(2654435761)) >> np.uint32(32 - 14)
    return np.searchsorted(starts, at, side="right") - 1, bucket.astype(np.int64)


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, bytes, starts) of some rows at a time; a longer row is a chunk of its own."""
    offsets, data = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, row + 1), n)
        yield row, last, data[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row]
        row = last


class TooManyLanguages(ValueError):
    """The text model of the declared languages would be larger than the settings allow."""


class TextModel:
    """Log-probabilities of the trigram buckets under every language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(1, keepdims=True))

    def means(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood of each row's grams under every language, and the number of grams."""
        rows, buckets = _grams(data, starts)
        n = len(starts) - 1
        counts = np.bincount(rows, minlength=n)
        sums = np.stack([np.bincount(rows, self.logs[i][buckets], n) for i in range(len(self.languages))], 1)
        return sums / np.maximum(counts, 1)[:, None], counts


def fit_text_model(rows: DataFrame, settings: Settings) -> TextModel:
    """The text model, on rows with a declared language whose hash falls below its language's share.

    One row per language that `least_rows` rows declare reaches the driver; without any, one of
    the sample's. More languages than a model of `most_model_bytes` holds stop the job
    (`TooManyLanguages`): none is left out for size.
    """
    labelled = rows.where(F.col("declared").isNotNull() & (F.length("text") > 0))
    counts = materialize(labelled.groupBy("declared").count())
    enough = counts.where(F.col("count") >= settings.least_rows)
    most = settings.most_model_bytes // (BUCKETS * 8)
    frequent = {r["declared"]: r["count"] for r in enough.limit(most + 1).collect()}
    if len(frequent) > most:
        raise TooManyLanguages(f"more than {most} languages are declared by {settings.least_rows} rows: raise least_rows or most_model_bytes")
    million = 1_000_000
    below = F.pmod(F.xxhash64("key", "text", F.lit(17)), F.lit(million))
    if frequent:
        each = max(settings.sample_rows // len(frequent), settings.least_rows)
        # The sample of a language holds fewer rows than `each` by chance, but hardly none.
        each = max(each, LEAST_SAMPLE)
        shares = enough.select(
            F.col("declared").alias("_of"), F.ceil(F.least(F.lit(1.0), each / F.col("count")) * million).alias("_below")
        )
        sample = labelled.join(F.broadcast(shares), F.col("declared") == F.col("_of")).where(below < F.col("_below"))
    else:
        total = counts.agg(F.sum("count")).first()[0] or 0
        sample = labelled.where(below < round(min(1.0, settings.sample_rows / max(total, 1)) * million))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist())
            for first, last, data, starts in _chunks(batch.column(1)):
                of, buckets = _grams(data, starts)
                for name in np.unique(names[first:last]):
                    own = (names[first:last] == name)
                    counts = np.bincount(buckets[own[of]], minlength=BUCKETS)
                    filled = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(name)] * (len(filled) + 1)), pa.array(np.append(filled, -1)),
                         pa.array(np.append(counts[filled], own.sum()))],
                        ["declared", "bucket", "grams"],
                    )

    found = (
        sample.select("declared", "text").mapInArrow(counted, "declared string, bucket long, grams long")
        .groupBy("declared", "bucket").agg(F.sum("grams").alias("grams")).toArrow()
    )
    names, buckets, grams = (found[c].to_numpy(zero_copy_only=False) for c in ("declared", "bucket", "grams"))
    known = sorted(frequent) or sorted(set(names)) or ["und"]
    table = np.zeros((len(known), BUCKETS))
    for i, name in enumerate(known):
        own = (names == name) & (buckets >= 0)
        table[i, buckets[own].astype(int)] = grams[own]
    return TextModel([str(n) for n in known], table)


def _text_evidence(batches: Iterator[pa.RecordBatch], model, settings: Settings) -> Iterator[pa.RecordBatch]:
    """`text` (log-likelihoods), `own` (their posterior) and `grams` in the place of the text, the last column."""
    model = model.value
    for batch in batches:
        for first, last, data, starts in _chunks(batch.column(batch.num_columns - 1)):
            means, counts = model.means(data, starts)
            logs = means * np.minimum(counts, settings.evidence_grams)[:, None]
            own = np.exp(logs - logs.max(1, keepdims=True))
            own /= own.sum(1, keepdims=True)
            size = logs.shape[1]
            lists = lambda x: pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(x.ravel())
            )
            rest = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [*rest.columns[:-1], lists(logs), lists(own), pa.array(counts.astype(np.int64))],
                [*rest.schema.names[:-1], "logs", "own", "grams"],
            )


def _summed(rows: DataFrame, by: list[str], size: int, name: str) -> DataFrame:
    """The posteriors summed for each group."""
    sums = F.array(*[F.sum(F.col("own")[i]) for i in range(size)])
    return rows.groupBy(*by).agg(sums.alias(name))


def _joined(rows: DataFrame, sums: DataFrame, by: str) -> DataFrame:
    """The group's sums beside each row; NULL where the row has no group."""
    return rows.join(sums.withColumnRenamed(by, "_by"), rows[by] == F.col("_by"), "left").drop("_by")


def identify_languages(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`key`, `text_hash`, `language`, `probability`, `text_language`, `rejected` for every row.

    `rows` has `key` (a LONG), `text`, `declared`, `suffix`, `host` and `domain`; any of them may be NULL, then it
    is no evidence. Texts without a letter (empty and NULL ones too) are rejected, whatever
    else speaks for a language. Ties fall to the first language by name. Repeated rows each
    count and each keep a row. Languages are those declared by enough rows of the table; a text
    unlike all of them has a low probability, and is rejected too.
    """
    spark = rows.sparkSession
    fitted = fit_text_model(rows, settings)
    model = spark.sparkContext.broadcast(fitted)
    languages, size = fitted.languages, len(fitted.languages)
    given = rows.select(
        "key", F.xxhash64("text").alias("text_hash"), "declared", "suffix", "host", "domain",
        F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")).alias("text"),
    )
    schema = (
        "key long, text_hash long, declared string, suffix string, host string, domain string, "
        "logs array<double>, own array<double>, grams long"
    )
    found = materialize(given.mapInArrow(lambda batches: _text_evidence(batches, model, settings), schema))
    counted = found.where("grams > 0")
    everything = _summed(counted, [], size, "all_sums")
    all_sums = [x or 0.0 for x in (everything.first()["all_sums"] or [0.0] * size)]
    total = sum(all_sums)
    overall = [(x + 1.0) / (total + size) for x in all_sums]

    def conditional(name: str) -> tuple[DataFrame, int]:
        groups = materialize(_summed(counted.where(F.col(name).isNotNull()), [name], size, f"{name}_sums"))
        return groups, groups.count()

    declared, n_declared = conditional("declared")
    suffix, n_suffix = conditional("suffix")
    host = splittable(_summed(counted.where("host is not null"), ["host"], size, "host_sums"))
    domain = splittable(_summed(counted.where("domain is not null"), ["domain"], size, "domain_sums"))
    joined = found
    for by, sums in (("declared", declared), ("suffix", suffix), ("host", host), ("domain", domain)):
        joined = _joined(joined, sums, by)

    # Scores are made of whole arrays, one place a language, so the plan is the same for any number of them.
    # What is the same for all languages enters a lambda as an array too: it is taken once a row.
    zeros = F.array_repeat(F.lit(0.0), size)
    repeated = lambda x: F.array_repeat(x, size)
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    plus = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    total_of = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def likelihood(sums: str, groups: int) -> Column:
        """log P(group | language), 0 without a group."""
        whole = numbers(x + settings.pseudo * max(groups, 1) for x in all_sums)
        return F.when(
            F.col(sums).isNotNull(), F.zip_with(sums, whole, lambda a, b: F.log((a + settings.pseudo) / b))
        ).otherwise(zeros)

    mine = F.when(F.col("grams") > 0, F.col("own")).otherwise(zeros)

    def prior(sums: str, above: Column) -> Column:
        """The group's share of each language without the row itself, smoothed towards the level above."""
        rest = F.zip_with(F.coalesce(sums, zeros), mine, lambda a, b: F.greatest(a - b, F.lit(0.0)))
        smoothed = F.zip_with(rest, above, lambda a, b: a + settings.strength * b)
        return F.zip_with(smoothed, repeated(total_of(rest) + settings.strength), lambda a, b: a / b)

    of_host = prior("host_sums", prior("domain_sums", numbers(overall)))
    evidence = plus(plus("logs", likelihood("declared_sums", n_declared)), likelihood("suffix_sums", n_suffix))
    # The last places hold sums that differ with the order of the rows.
    scores = F.zip_with(evidence, of_host, lambda a, b: F.round(a + F.log(b), 6))
    names = F.array(*[F.lit(n) for n in languages])
    scored = joined.select("key", "text_hash", "grams", "logs", scores.alias("scores"))
    best = F.array_max("scores")
    spread = total_of(F.zip_with("scores", repeated(best), lambda a, b: F.exp(a - b)))
    # The background is as likely as the best language but for the text.
    grams = F.least("grams", F.lit(settings.evidence_grams))
    text_of_best = F.get("logs", (F.array_position("scores", best) - 1).cast("int"))
    unlike = F.exp(F.least(F.log(F.lit(settings.background)) - grams * math.log(BUCKETS) - text_of_best, F.lit(500.0)))
    named = scored.select(
        "key", "text_hash", "grams", names[(F.array_position("scores", best) - 1).cast("int")].alias("language"),
        F.round(1.0 / (spread + unlike), 6).alias("probability"),
        F.when(F.col("grams") > 0, names[(F.array_position("logs", F.array_max("logs")) - 1).cast("int")]).alias("text_language"),
    )
    rejected = (F.col("grams") == 0) | (F.col("probability") < settings.least_probability)
    return named.select("key", "text_hash", "language", "probability", "text_language", rejected.alias("rejected"))


_TAGS = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>"


def language_code(declared: Column) -> Column:
    """The language of a declared tag in lower case: "EN", "en-US" and "en_GB" are "en".

    NULL where the tag begins with no code of two or three letters.
    """
    code = F.lower(F.regexp_extract(declared, r"^\s*([a-zA-Z]{2,3})(?![a-zA-Z0-9])", 1))
    return F.when(code != "", code)


def page_evidence(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The rows that `identify_languages` takes, from web pages: tags stripped, `lang`, and the parts of the address."""
    page, address = F.coalesce(F.col(html).cast("string"), F.lit("")), F.lower(F.col(url).cast("string"))
    blank = lambda x: F.when(x != "", x)
    host = blank(F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1))
    declared = language_code(F.regexp_extract(page, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z0-9_-]+)", 1))
    return pages.select(
        F.col(id).cast("long").alias("key"), F.regexp_replace(page, _TAGS, " ").alias("text"),
        declared.alias("declared"), blank(F.substring_index(host, ".", -1)).alias("suffix"),
        host.alias("host"), F.substring_index(host, ".", -2).alias("domain"),
    )


def document_evidence(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that `identify_languages` takes, from documents: the source stands for the host."""
    return docs.select(
        F.col(id).cast("long").alias("key"), F.col(text).cast("string").alias("text"), language_code(F.col(lang).cast("string")).alias("declared"),
        F.lit(None).cast("string").alias("suffix"), F.col(source).alias("host"), F.lit(None).cast("string").alias("domain"),
    )


def keep_identified(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, source and any others) whose language is not rejected.

    Repeated rows and rows of equal id stay or go each for itself; rows with a NULL or empty text are
    rejected for want of a letter, NULL ids, languages and sources are no reason to be. An empty table
    stays empty. Further columns are kept, whatever their names.
    """
    found = identify_languages(document_evidence(docs), settings).where("rejected")
    gone = stored(found.select(
        F.col("key").alias("_gone_key"), F.col("text_hash").alias("_gone_hash"),
        F.xxhash64("key", "text_hash").alias("_gone_both"),
    ).distinct())
    # The row travels as one column, so that no name of it can clash with the helpers'.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(row, F.col("doc_id").cast("long").alias("key"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    marked = marked.withColumn("maybe", maybe_in(gone.select("_gone_both"), F.xxhash64("key", "hash")))
    same = F.col("key").eqNullSafe(F.col("_gone_key")) & (F.col("hash") == F.col("_gone_hash"))
    doubtful = marked.where("maybe").join(gone, same, "left_anti")
    return marked.where("not maybe").unionByName(doubtful).select("row.*")
