"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or the same document,
earlier). Equal strings are brought together by content: every window of ``LENGTH`` bytes is anchored at its run of
``GRAM`` bytes with the smallest hash, so equal windows share an anchor. The windows of one anchor in one place of a
document are a stretch. Of equal stretches of one anchor only the first can hold new strings; the others go whole. Where
an anchor has several different stretches, the first ones are sorted as suffixes, equal windows stand side by side
there, and all but the first of them go.

An anchor that more than ``GROUP`` different stretches share is dealt anew by longer runs, up to whole windows, so no
group of stretches outgrows a task; the windows stay the same and each of them stays with its equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from bindmill.llm.common import read, text_of
from bindmill.llm.hashing import RangeHash
from bindmill.llm.suffix_array import suffix_array
from bindmill.session import durable

LENGTH = 100
GRAM = 48
LONGER_GRAMS = (74, 87, 94, 97, 99, 100)
GROUP = 1000  # stretches whose suffixes are sorted together
BLOCK = 1 << 20  # windows whose anchors are sought at once
CHUNK_BYTES = 16_000_000  # of texts whose stretches are collapsed together
NO_ID = (1 << 63) - 1  # place of a missing doc_id in the order of documents
STRETCH = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "content", "doc", "text_hash", "start", "stop")])


def stretches(data: np.ndarray, gram: int, hashes: RangeHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content hash, first window and end (of the last window) of each stretch of a text."""
    found = []
    for begin in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        part = data[begin:begin + BLOCK + LENGTH - 1]
        sums = hashes.prefix(part)
        value = hashes.runs(sums, gram)
        # the leftmost smallest of each window: the place fills the low bits, which decide between equal high bits
        least = (value & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(value), dtype=np.uint64)
        span, width = LENGTH - gram + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        stop = np.concatenate([first[1:], [len(at)]]) + LENGTH - 1
        found.append((value[at[first]], hashes.ranges(sums, first, stop), first + begin, stop + begin))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of the given ones, by document (a number)."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    shift = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + doc * shift) - doc * shift
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    begin = np.flatnonzero(new)
    last = np.concatenate([begin[1:], [len(doc)]]) - 1
    return doc[begin], start[begin], reach[last]


def _collapse(docs: np.ndarray, texts: np.ndarray, bodies: list[np.ndarray], hashes: RangeHash) -> pd.DataFrame:
    """Stretches of some texts: the first of each (anchor, content), and merged intervals of the others (``certain``)."""
    parts = [stretches(b, GRAM, hashes) for b in bodies]
    anchor, content, start, stop = (np.concatenate(x) for x in zip(*parts))
    row = np.repeat(np.arange(len(bodies)), [len(p[0]) for p in parts])
    doc, text = docs[row], texts[row]
    order = np.lexsort((start, text, doc, content, anchor))
    anchor, content, doc, text, start, stop, row = (x[order] for x in (anchor, content, doc, text, start, stop, row))
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)
    same = (doc == doc[head]) & (text == text[head]) & (start == start[head])  # the row itself, or a repeated row
    later = ~new & ~same
    gone, begin, end = merged(row[later], start[later], stop[later])
    none = np.zeros(len(gone), dtype=np.int64)
    return pd.DataFrame({
        "anchor": np.concatenate([anchor[new].view(np.int64), none]),
        "content": np.concatenate([content[new].view(np.int64), none]), "doc": np.concatenate([doc[new], docs[gone]]),
        "text_hash": np.concatenate([text[new], texts[gone]]), "start": np.concatenate([start[new], begin]),
        "stop": np.concatenate([stop[new], end]), "certain": np.concatenate([np.zeros(int(new.sum()), bool),
                                                                               np.ones(len(gone), bool)])})


def _find_stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = RangeHash()
    for batch in batches:
        bodies = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in batch["text"]]
        docs, texts = batch["doc"].to_numpy(np.int64), batch["text_hash"].to_numpy(np.int64)
        ends = np.cumsum([len(b) for b in bodies])
        chunk = ends // CHUNK_BYTES
        for k in np.unique(chunk):
            rows = np.flatnonzero(chunk == k)
            yield _collapse(docs[rows], texts[rows], [bodies[r] for r in rows], hashes)


def repeated_windows(rows: list[tuple]) -> list[tuple[int, int]]:
    """(doc, text_hash, start, bytes) of different stretches of one anchor -> (row, place in it) of windows that go.

    The suffixes of all stretches are sorted at once. Of the windows' suffixes, those with equal windows are
    neighbours; of each such run all but the first window in the order of documents go.
    """
    text: list[int] = []
    owner, offset, valid = [], [], []
    for k, (_, _, _, body) in enumerate(rows):
        text += [b + 2 for b in body]
        text.append(1)
        n = len(body) - LENGTH + 1
        owner += [k] * (len(body) + 1)
        offset += range(len(body) + 1)
        valid += [True] * n + [False] * (len(body) + 1 - n)
    run: list[int] = []
    last, out = None, []

    def close() -> None:
        if len(run) > 1:
            keys = [(*rows[owner[s]][:2], rows[owner[s]][2] + offset[s]) for s in run]
            least = min(keys)
            out.extend((owner[s], offset[s]) for s, key in zip(run, keys) if key != least)

    for s in suffix_array(text):
        if not valid[s]:
            continue
        window = rows[owner[s]][3][offset[s]:offset[s] + LENGTH]
        if window != last:
            close()
            run, last = [], window
        run.append(s)
    close()
    return out


def _sort_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by anchor -> intervals that go; a group may go on in the next batch."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        anchors = batch["anchor"].to_numpy()
        edge = int(np.searchsorted(anchors, anchors[-1]))  # the last group stays until its end is known
        if held and held[0]["anchor"].iloc[0] != anchors[0]:
            yield _sorted(pd.concat(held))
            held = []
        if edge > 0:
            yield _sorted(pd.concat([*held, batch.iloc[:edge]]))
            held = []
        held.append(batch.iloc[edge:])
    if held:
        yield _sorted(pd.concat(held))


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    anchors = frame["anchor"].to_numpy()
    docs, texts, starts = (frame[c].to_numpy() for c in ("doc", "text_hash", "start"))
    bodies = frame["body"].tolist()
    edges = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, [len(anchors)]])
    gone: list[tuple[int, int]] = []
    for begin, end in zip(edges[:-1], edges[1:]):
        group = [(int(docs[k]), int(texts[k]), int(starts[k]), bytes(bodies[k])) for k in range(begin, end)]
        gone += [(begin + k, at) for k, at in repeated_windows(group)]
    rows = np.array([k for k, _ in gone], dtype=np.int64)
    begins = np.array([at for _, at in gone], dtype=np.int64)
    rows, begins, ends = merged(rows, begins, begins + LENGTH)
    return pd.DataFrame({"doc": docs[rows], "text_hash": texts[rows], "start": starts[rows] + begins,
                         "stop": starts[rows] + ends})


def _cut_anew(gram: int):
    """Stretches -> stretches of the same windows by anchors of a longer run."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = RangeHash()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                body = bytes(r.body)
                anchor, content, start, stop = stretches(np.frombuffer(body, np.uint8), gram, hashes)
                with np.errstate(over="ignore"):
                    anchor = (anchor + np.uint64(gram)).view(np.int64)
                rows += [(a, c, r.doc, r.text_hash, r.start + s, r.start + e, body[s:e]) for a, c, s, e in zip(
                    anchor.tolist(), content.view(np.int64).tolist(), start.tolist(), stop.tolist())]
            yield pd.DataFrame(rows, columns=["anchor", "content", "doc", "text_hash", "start", "stop", "body"])

    return cut


def _firsts(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """The first of each (anchor, content), of those anchors that have several; the intervals of all others."""
    place = F.struct("doc", "text_hash", "start")
    first = rows.groupBy("anchor", "content").agg(F.min(place).alias("first"))
    several = first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "n")
    joined = rows.join(first, ["anchor", "content"])
    later = joined.where(place != F.col("first")).select("doc", "text_hash", "start", "stop")
    here = joined.where(place == F.col("first")).dropDuplicates(["anchor", "content"]).join(several, "anchor")
    return here.select("anchor", "content", "doc", "text_hash", "start", "stop", "n", *more), later


def repeated_intervals(texts: DataFrame) -> DataFrame:
    """(doc, text_hash, text) -> doc, text_hash, start, stop of bytes that go; intervals may overlap."""
    schema = T.StructType([*STRETCH.fields, T.StructField("certain", T.BooleanType())])
    found = texts.mapInPandas(_find_stretches, schema)
    # intervals that are certain need no company, so they are spread by document
    by = F.when(F.col("certain"), F.xxhash64("doc", "text_hash", "start")).otherwise(F.col("anchor"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = found.withColumn("by", by).repartition(parts, "by").withColumn(
        "met", F.count("*").over(Window.partitionBy("by")))
    kept = durable(met.where(F.col("certain") | (F.col("met") > 1)).drop("by", "met"))
    certain = kept.where("certain").select("doc", "text_hash", "start", "stop")
    here, later = _firsts(kept.where("not certain").drop("certain"))
    here, later = durable(here), durable(later)
    body = here.join(texts.withColumnsRenamed({"doc": "d", "text_hash": "h"}),
                     (F.col("doc") == F.col("d")) & (F.col("text_hash") == F.col("h")))
    cut = F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    groups = durable(body.withColumn("body", cut).select(*here.columns, "body").dropDuplicates(["anchor", "content"]))
    gone = certain.union(later)
    sortable = T.StructType([f for f in STRETCH.fields if f.name in ("doc", "text_hash", "start", "stop")])
    for gram in (*LONGER_GRAMS, None):
        small = groups.where(F.col("n") <= GROUP) if gram else groups
        dealt = small.select("anchor", "doc", "text_hash", "start", "body").repartition(parts, "anchor")
        gone = gone.union(durable(dealt.sortWithinPartitions("anchor").mapInPandas(_sort_groups, sortable)))
        large = groups.where(F.col("n") > GROUP)
        if not gram or large.isEmpty():
            return gone
        again = T.StructType([*STRETCH.fields, T.StructField("body", T.BinaryType())])
        anew = durable(large.select(*again.fieldNames()).mapInPandas(_cut_anew(gram), again))
        here, later = _firsts(anew, "body")
        groups, gone = durable(here), gone.union(durable(later))
    return gone


REMAINS = T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")


@F.pandas_udf(REMAINS)
def remains(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, spans in batches:
        rows = []
        for text, gone in zip(texts, spans):
            body = text.encode("utf-8", "replace")
            start = np.array([g["start"] for g in gone] if gone is not None else [], dtype=np.int64)
            stop = np.array([g["stop"] for g in gone] if gone is not None else [], dtype=np.int64)
            _, start, stop = merged(np.zeros(len(start), np.int64), start, stop)
            edges = [0, *np.stack([start, stop], axis=1).ravel().tolist(), len(body)]
            kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((len(body), len(body) - len(kept), len(start), kept))
        yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (bytes): one row per row.

    Documents are ordered by doc_id, missing ids last, then by a hash of the text. Rows equal in both are one document
    and get the same result. Null and empty texts, and texts under ``LENGTH`` bytes, lose nothing.
    """
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("text"))
    gone = repeated_intervals(rows.select("doc", "text_hash", "text").where(F.octet_length("text") >= LENGTH))
    spans = gone.groupBy(F.col("doc").alias("d"), F.col("text_hash").alias("h")).agg(
        F.collect_list(F.struct("start", "stop")).alias("spans"))  # of one document: bounded by its length
    joined = rows.join(spans, (F.col("doc") == F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.select("doc_id", remains("text", "spans").alias("r")).select("doc_id", "r.*")


def op6_linear_grouping(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's bytes, removed bytes and spans, and the hash of what is left."""
    left = remove_repeats(read(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_linear_grouping": op6_linear_grouping}
ORACLES: dict[str, str] = {}
