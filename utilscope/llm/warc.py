"""Web archive records, and a Merkle audit of their fixity.

Pages become WARC records, numbered in a stable order and packed into files of a fixed number of
records. A file's records and the byte ranges that they cover are hashed into a tree: a leaf is
a record's SHA-256, an inner node the SHA-256 of its children's digests and lengths, in order.
The trees of all files meet in one root. Two replicas are compared from the root down: the
children of equal nodes are never looked at, so the work below the root follows the damage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utilscope.llm.numbering import numbered
from utilscope.llm.storage import materialize

FILE_RECORDS = 256
FANOUT = 16
# Fixed values of the format.
END = "\r\n\r\n"
MAGIC = b"WARC/1.1\r\n"
#: Records carry this date, so that equal pages give equal bytes.
DATE = "2000-01-01T00:00:00Z"


def record(url: Column, page: Column) -> Column:
    """The bytes of a page's record as text: headers, payload; the closing END is not included."""
    identity = F.md5(F.concat_ws("\n", url, page))
    part = lambda start, n: F.substring(identity, start, n)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(f">\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(page).cast("string"), F.lit(END), page,
    )


def records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`id`, `url`, `record` for every page. NULL addresses and pages are empty."""
    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    page = F.coalesce(F.col(html).cast("string"), F.lit(""))
    return pages.select(F.col(id).cast("long").alias("id"), address.alias("url"), record(address, page).alias("record"))


def leaves(rows: DataFrame) -> DataFrame:
    """Digest, length and place of every record: `file`, `place`, `start`, `length`, `digest`, `id`, `url`.

    Records are ordered by id (NULL first), address and digest; repeated records follow each
    other. Only digests are moved, never the records.
    """
    small = rows.select(
        "id", "url", F.sha2(F.encode("record", "UTF-8"), 256).alias("digest"),
        (F.octet_length("record") + len(END)).cast("long").alias("length"),
    )
    placed = numbered(small, ["id", "url", "digest"], "n")
    ranks = placed.select(
        "id", "url", "digest", "length", F.expr(f"n div {FILE_RECORDS}").alias("file"),
        F.expr(f"cast(n % {FILE_RECORDS} as int)").alias("place"),
    )
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("length").over(before), F.lit(0))
    return ranks.select("file", "place", start.alias("start"), "length", "digest", "id", "url")


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above nodes (`node`, `digest`, `length`, `records`): at most FANOUT children each."""
    children = F.array_sort(F.collect_list(F.struct("node", "digest", "length", "records")))
    grouped = nodes.groupBy(F.expr(f"node div {FANOUT}").alias("parent")).agg(children.alias("children"))
    text = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["digest"], c["length"].cast("string"))), "\n")
    total = lambda name: F.aggregate(f"children.{name}", F.lit(0).cast("long"), lambda a, x: a + x)
    return grouped.select(
        F.col("parent").alias("node"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"),
        total("length").alias("length"), total("records").alias("records"),
    )


def tree(found: DataFrame) -> list[DataFrame]:
    """Levels of the tree from the leaves to the root; a level has `node`, `digest`, `length`, `records`.

    A leaf's node is its file and place, so a lost record leaves a gap and moves no other. Files
    whose number of records is a power of FANOUT share no inner node below their own root.
    """
    node = F.col("file") * FILE_RECORDS + F.col("place")
    levels = [materialize(found.select(node.alias("node"), "digest", "length", F.lit(1).cast("long").alias("records")))]
    top = levels[0].agg(F.max("node")).first()[0]
    while top:
        levels.append(materialize(_parents(levels[-1])))
        top //= FANOUT
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """Leaves in which two trees differ: `node`, `kind` ('changed', 'missing' or 'extra' in theirs), and both digests.

    From the higher root down, only children of differing nodes are compared.
    """
    height = max(len(ours), len(theirs))
    empty = ours[0].limit(0)
    level = lambda levels, i: levels[i] if i < len(levels) else (_raised(levels[-1], i - len(levels) + 1) if levels else empty)
    wrong = None
    for i in reversed(range(height)):
        sides = []
        for levels, name in ((ours, "expected"), (theirs, "found")):
            nodes = level(levels, i)
            if wrong is not None:
                above = wrong.select(F.col("node").alias("above"))
                nodes = nodes.join(above, F.expr(f"node div {FANOUT}") == F.col("above"), "left_semi")
            sides.append(nodes.select("node", F.col("digest").alias(name), F.col("length").alias(f"{name}_length")))
        wrong = materialize(
            sides[0].join(sides[1], "node", "full").where(
                ~F.col("expected").eqNullSafe(F.col("found")) | ~F.col("expected_length").eqNullSafe(F.col("found_length"))
            )
        )
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed")
    return wrong.select("node", kind.alias("kind"), "expected", "found")


def _raised(root: DataFrame, levels: int) -> DataFrame:
    """The root of a lower tree, put so many levels higher."""
    for _ in range(levels):
        root = _parents(root)
    return root


# --- files -------------------------------------------------------------------------


def write_archive(rows: DataFrame, path: str) -> None:
    """Write the records as WARC files below `path`, one folder `file=N` each, placed as by `leaves`."""
    keyed = rows.withColumn("digest", F.sha2(F.encode("record", "UTF-8"), 256))
    placed = numbered(keyed, ["id", "url", "digest"], "n").withColumn("file", F.expr(f"n div {FILE_RECORDS}"))
    lines = placed.repartition("file").sortWithinPartitions("file", "n")
    lines.select("file", "record").write.partitionBy("file").option("lineSep", END).text(path)


def _parsed(content: bytes) -> Iterator[tuple[int, int, str, str | None]]:
    """(start, length, digest, address) of the records of a file.

    A record whose header is damaged, or whose length does not lead to an END, reaches to the next
    header behind an END.
    """
    mark, at = END.encode(), 0
    while at < len(content):
        head = content.find(mark, at) if content.startswith(MAGIC, at) else -1
        fields = dict(
            line.split(": ", 1) for line in content[at:head].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line
        ) if head >= 0 else {}
        size = fields.get("Content-Length", "")
        end = head + len(END) + int(size) if size.isascii() and size.isdigit() and len(size) < 19 else len(content)
        if not content.startswith(mark, end):
            end = content.find(mark + MAGIC, at)
            if end < 0:
                end = len(content) - (len(END) if content.endswith(mark) and len(content) - at >= len(END) else 0)
        yield at, end + len(END) - at, hashlib.sha256(content[at:end]).hexdigest(), fields.get("WARC-Target-URI")
        at = end + len(END)


_READ = "file long, place int, start long, length long, digest string, url string"
_READ_ARROW = pa.schema([("file", pa.int64()), ("place", pa.int32()), ("start", pa.int64()),
                         ("length", pa.int64()), ("digest", pa.string()), ("url", pa.string())])


def _read(spark, path: str) -> DataFrame:
    """The records of the files in their order, `place` counting those that are there, and their `url`."""
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(file, place, *found) for place, found in enumerate(_parsed(content))]
                yield pa.RecordBatch.from_pylist([dict(zip(_READ_ARROW.names, r)) for r in rows], _READ_ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    number = F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long")
    return files.select(number.alias("file"), "content").mapInArrow(parsed, _READ)


def read_archive(spark, path: str) -> DataFrame:
    """`file`, `place`, `start`, `length`, `digest` of every record of the files that `write_archive` wrote.

    `place` counts the records that are there; `read_replica` tells the places that they had.
    """
    return _read(spark, path).drop("url")


def _gap(found: list[dict], expected: list[dict]) -> list[int | None]:
    """For each of the found records between two intact ones the place among the expected ones there, in order.

    By address, else by the distance from the intact record before or behind and the length,
    else the first place left; None for a record too many.
    """
    taken: dict[int, int] = {}

    def room(j: int) -> range:
        low = max((i for k, i in taken.items() if k < j), default=-1) + 1
        return range(low, min((i for k, i in taken.items() if k > j), default=len(expected)))

    def from_left(rows: list[dict], k: int) -> int:
        return rows[k]["start"] - rows[0]["start"]

    def from_right(rows: list[dict], k: int) -> int:
        return rows[-1]["start"] + rows[-1]["length"] - rows[k]["start"]

    same_length = lambda j, i: found[j]["length"] == expected[i]["length"]
    for same in (
        lambda j, i: found[j]["url"] is not None and found[j]["url"] == expected[i]["url"],
        lambda j, i: same_length(j, i) and from_left(found, j) == from_left(expected, i),
        lambda j, i: same_length(j, i) and from_right(found, j) == from_right(expected, i),
        lambda j, i: len(found) >= len(expected) and from_left(found, j) == from_left(expected, i),
        lambda j, i: True,
    ):
        for j in range(len(found)):
            if j not in taken:
                place = next((i for i in room(j) if same(j, i)), None)
                if place is not None:
                    taken[j] = place
    return [taken.get(j) for j in range(len(found))]


def _places(found: list[dict], expected: list[dict]) -> list[int | None]:
    """The places of a file's found records: intact ones by their digests in order, others between them."""
    if not expected:
        return [j if j < FILE_RECORDS else None for j in range(len(found))]
    places: list[int | None] = [None] * len(found)
    matcher = SequenceMatcher(None, [e["digest"] for e in expected], [f["digest"] for f in found], autojunk=False)
    for kind, i, i_end, j, j_end in matcher.get_opcodes():
        if kind in ("equal", "replace"):
            inner = range(i_end - i) if kind == "equal" else _gap(found[j:j_end], expected[i:i_end])
            places[j:j_end] = [None if k is None else expected[i + k]["place"] for k in inner]
    return places


def read_replica(spark, path: str, expected: DataFrame) -> DataFrame:
    """What `read_archive` tells, with the places that the records have in `expected` (by `leaves`).

    A lost record moves no other, and a damaged one takes its own place. `place` is NULL for
    records that have none. The records of a file are compared in one task.
    """
    def placed(_, found: pa.Table, told: pa.Table) -> pa.Table:
        rows = sorted(found.to_pylist(), key=lambda r: r["start"])
        places = _places(rows, sorted(told.to_pylist(), key=lambda r: r["place"]))
        return pa.Table.from_pylist([r | {"place": p} for r, p in zip(rows, places)], _READ_ARROW)

    told = expected.select("file", "place", "start", "length", "digest", "url")
    both = _read(spark, path).groupBy("file").cogroup(told.groupBy("file"))
    return both.applyInArrow(placed, _READ).drop("url")


def audit_archive(spark, path: str, expected: DataFrame) -> DataFrame:
    """`audit` of the files below `path` against `expected` (by `leaves`); `node` is NULL for records without a place."""
    found = materialize(read_replica(spark, path, expected))
    wrong = audit(tree(expected), tree(found.where("place is not null")))
    strays = found.where("place is null").select(
        F.lit(None).cast("long").alias("node"), F.lit("extra").alias("kind"),
        F.lit(None).cast("string").alias("expected"), F.col("digest").alias("found"),
    )
    return wrong.unionByName(strays)
