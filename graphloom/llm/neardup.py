"""Near-duplicate detection: a signature-coordinate inverted join over MinHash signatures.

Texts with equal shingle sets form one class.  Each class has K minima (coordinates); it is posted
under its coordinate-value pairs.  A pair of classes above the similarity agrees on at least T of the
K coordinates (missed with a chance of about 1e-8 at the threshold itself), so it shares a posting
even if each class is posted under only the K - T + 1 rarest of its pairs: common values are skipped.
Any one order of the values would do; they are ordered by a count sketch, whose cells grow with the
classes up to a fixed number.  Its counts stay with the executors; the driver gets and broadcasts only
the logarithms of those above `HOT`, compressed.

Lists that the sketch shows to hold at most `HOT` classes yield all their pairs; those that agree on T
coordinates are confirmed on full shingle sets.  In the other lists, a class with so many shingles of its
own (that no other class of such lists has) that it can't be similar to any is left out, and each class
meets the list's hub, the class with the fewest shingles of its own: the text of which the others are
copies, if it is there.  Links make components.  Where the classes that met one hub are still in several
components, a pair that is left shares a shingle that the hub hasn't, or both share with the hub alone
as many as a link needs: the first are found by posting those shingles, the second by size, and in both
cases one of the two is outside the largest component.  So copies of a text, or texts that only have a
passage in common, cost in proportion to their number, and no link that could join two components is
left out.

Defined results: null, empty and wordless texts have no shingles, are linked with nothing and are
kept; rows with a null doc_id are not linked and get no component; repeated rows are copies of each
other with one component; a doc_id with several texts is judged row by row; an empty table gives an
empty result; other columns are never looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.components import connected_components
from graphloom.llm.scratch import Scratch

K = 64
SHINGLE = 5
PERCENT = 80
#: A posting list that may be longer than this is treated as hot.
HOT = 32
#: Cells of the count sketch, 2 to this power: one for eight coordinates, from the least to the most.  At the most,
#: a byte each is 64 MB, however many texts there are.
SKETCH_BITS, MOST_SKETCH_BITS = 22, 26
#: Cells, 2 to this power, that are counted together.
CHUNK_BITS = 16
#: Sizes within this ratio are looked up together.
BAND = 1.02
_FACTORS = (tk.mix(np.arange(1, K + 1, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_ADD = (tk.mix(np.arange(1001, K + 1001, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def match_threshold(percent: int, k: int = K) -> int:
    """Coordinates on which a pair at the threshold agrees but for six standard deviations."""
    j = percent / 100
    return max(1, math.floor(k * j - 6 * math.sqrt(k * j * (1 - j))))


def shingle_sets(b: tk.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block, sorted within the text, and their offsets."""
    starts, ends, words = b.spans(tk.NONSPACE[b.raw])
    w = b.hashes(starts, ends, tk.LOWER)
    n = np.diff(words)
    counts = np.where(n == 0, 0, np.maximum(1, n - k + 1))
    at = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(b.n), counts)
    first = words[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    last = words[1:][doc]
    h = np.zeros(len(first), np.uint64)
    for j in range(k):
        to = first + j
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += np.where(to < last, w[np.minimum(to, max(len(w) - 1, 0))], np.uint64(77)) if len(w) else np.uint64(0)
    h = tk.mix(h)
    for i in np.flatnonzero(counts > 1):
        h[at[i] : at[i + 1]].sort()
    new = np.ones(len(h), np.bool_)
    if len(h) > 1:
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate(([0], np.cumsum(tk.sums(new, at))))


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The K minima of each set that is not empty, one row each."""
    some = at[:-1][np.diff(at) > 0]
    out = np.empty((len(some), K), np.uint32)
    if len(some):
        x = (sets >> np.uint64(32)).astype(np.uint32)
        value = np.empty_like(x)
        for k in range(K):
            np.multiply(x, _FACTORS[k], out=value)
            value += _ADD[k]
            out[:, k] = np.minimum.reduceat(value, some)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary array with one value per row of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for b in tk.blocks(tk.string_column(batch, "text")):
                sets, at = shingle_sets(b, k)
                n = np.diff(at)
                full = np.zeros((b.n, K), np.uint32)
                full[n > 0] = signatures(sets, at)
                mixed = tk.mix(sets + np.uint64(0x1234567))
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
                again = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tk.mix(mixed ^ np.uint64(0x55AA55AA55AA55AA)))))
                s1, s2 = total[at[1:]] - total[at[:-1]], again[at[1:]] - again[at[:-1]]
                yield pa.RecordBatch.from_arrays([ids.slice(b.first, b.n), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), _binary(full)], ["doc_id", "n_shingles", "s1", "s2", "sig"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.blocks(tk.string_column(batch, "text")):
                sets, at = shingle_sets(b, k)
                values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n), values], ["id", "grams"])

    return run


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each gram of a batch of (id, grams) with the number of rows that have it and one of their ids."""
    for batch in batches:
        grams = batch.column(1)
        if len(batch):
            at = grams.offsets.to_numpy()
            ids = np.repeat(batch.column(0).to_numpy(), np.diff(at))
            gram, one, n = np.unique(grams.values.to_numpy()[at[0] : at[-1]], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64)), pa.array(ids[one])], ["gram", "n", "id"])


def _sig_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), K)


def _coordinate_keys(sig: np.ndarray) -> np.ndarray:
    return (np.arange(K, dtype=np.uint64) << np.uint64(32)) | sig.astype(np.uint64)


def sketch_bits(classes: int) -> int:
    return min(MOST_SKETCH_BITS, max(SKETCH_BITS, (classes * K // 8).bit_length()))


def _cells(keys: np.ndarray, bits: int) -> np.ndarray:
    return (tk.mix(keys) >> np.uint64(64 - bits)).astype(np.int64)


def _chunk_cells(bits: int):
    """The cells of a batch's coordinates, once for each coordinate, as 16-bit places in their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = np.arange(1 << bits - CHUNK_BITS)
        for batch in batches:
            if len(batch):
                cells = np.sort(_cells(_coordinate_keys(_sig_rows(batch.column(0))), bits), axis=None)
                offsets = np.append(np.searchsorted(cells, chunks << CHUNK_BITS), len(cells)) * 2
                places = (cells & (1 << CHUNK_BITS) - 1).astype(np.uint16)
                column = pa.Array.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(places.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(chunks.astype(np.int32)), column], ["chunk", "places"])

    return run


def _hot_levels(hot: int):
    """The counts of a chunk as levels: 0 up to `hot`, else seven times the logarithm; no row if all are 0."""

    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << CHUNK_BITS, np.int64)
        for places in table.column("places"):
            counts += np.bincount(np.frombuffer(places.as_py(), np.uint16), minlength=len(counts))
        levels = np.where(counts > hot, np.maximum(1, 7 * np.log2(np.maximum(counts, 1))), 0).astype(np.uint8)
        rows = [(table.column("chunk")[0].as_py(), zlib.compress(levels.tobytes(), 1))] if levels.any() else []
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int32()), "levels": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _post(sketch_cast, prefix: int):
    """Each class under its `prefix` rarest coordinate-value pairs, and whether their lists may be hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, chunks = sketch_cast.value
        levels = np.zeros(1 << bits, np.uint8)
        for chunk, packed in chunks:
            levels[chunk << CHUNK_BITS : chunk + 1 << CHUNK_BITS] = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in batches:
            if not len(batch):
                continue
            keys = _coordinate_keys(_sig_rows(batch.column(1)))
            count = levels[_cells(keys, bits)]
            # The order is one for all classes: level (0 unless hot), then coordinate and value.
            pick = np.argsort(count, axis=1, kind="stable")[:, :prefix]
            key = np.take_along_axis(keys, pick, 1).reshape(-1).view(np.int64)
            hot = np.take_along_axis(count, pick, 1).reshape(-1) > 0
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(batch.column(0).to_numpy(), prefix)), pa.array(hot)], ["key", "id", "hot"])

    return run


def _agree(least: int):
    """Pairs whose signatures agree on at least `least` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                same = (_sig_rows(batch.column(2)) == _sig_rows(batch.column(3))).sum(1)
                yield batch.select([0, 1]).filter(pa.array(same >= least))

    return run


class NearDuplicates:
    """The steps of one run; `assigned` is doc_id, n_shingles and component_id per row."""

    def __init__(self, documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, hot: int = HOT):
        self.spark = documents.sparkSession
        self.scratch = Scratch(self.spark, "neardup")
        self.documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.shingle, self.percent, self.hot = shingle, percent, hot
        self.least = match_threshold(percent)

    def run(self) -> DataFrame:
        s = self.scratch
        signed = s.put(self.documents.mapInArrow(_sign(self.shingle), "doc_id long, n_shingles long, s1 long, s2 long, sig binary"), "signed")
        self.signed = signed
        linkable = signed.filter("n_shingles > 0 and doc_id is not null")
        groups = s.put(linkable.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("id")), "groups")
        ids = groups.select("id").distinct()
        classes = linkable.select(F.col("doc_id").alias("id"), "sig").join(ids, "id", "left_semi").dropDuplicates(["id", "sig"])
        classes = s.put(classes, "classes")
        lists = self._postings(classes)
        s.settle()
        pairs = self._short_pairs(lists)
        long = lists.filter("hot").select("key", "id")
        hot_ids = s.put(long.select("id").distinct(), "hot_ids")
        hot_sets = self._sets(hot_ids)
        room = self._room(hot_sets, hot_ids)
        long = s.put(long.join(room.filter(100 * F.col("most") >= self.percent * F.col("least")), "id"), "long")
        pairs = s.put(self._agreeing(pairs, classes), "pairs")
        s.settle()
        nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = self._sets(nodes.join(hot_ids, "id", "left_anti"))
        both = self._hubs_of_lists(long)
        met, hubs = self._met(both, hot_sets)
        s.settle()
        moved = self._moved(both, met, room)
        s.drop(hubs)
        again, hubs = self._met(moved, hot_sets)
        star = met.unionByName(again).filter((F.col("id") != F.col("hub")) & (100 * F.col("shared") >= self.percent * (F.col("n") + F.col("n_hub") - F.col("shared"))))
        star = star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        links = s.put(self._confirmed(pairs, sets.unionByName(hot_sets)).unionByName(star).distinct(), "links")
        s.settle()
        labels = connected_components(links, s)
        rest = s.put(self._agreeing(self._cross_pairs(again, hubs, hot_sets, labels), classes), "cross")
        if not rest.isEmpty():
            more = s.put(links.unionByName(self._confirmed(rest, hot_sets)), "links")
            s.drop(links)
            links, labels = more, connected_components(more, s)
        s.drop(lists, long, pairs, rest, room, sets, hot_sets, hot_ids, classes, both, met, moved, again, hubs)
        s.settle()
        self.links = links
        component = groups.join(labels.withColumnRenamed("node", "id"), "id", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "id").alias("component_id"))
        rows = signed.select("doc_id", "n_shingles", "s1", "s2")
        out = rows.filter("n_shingles > 0 and doc_id is not null").join(component, ["s1", "s2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
        alone = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return out.unionByName(alone)

    def _postings(self, classes: DataFrame) -> DataFrame:
        """(key, id, hot): a list that is not hot has at most `hot` classes."""
        bits = sketch_bits(classes.count())
        places = classes.select("sig").mapInArrow(_chunk_cells(bits), "chunk int, places binary")
        levels = places.groupBy("chunk").applyInArrow(_hot_levels(self.hot), "chunk int, levels binary").collect()
        cast = self.spark.sparkContext.broadcast((bits, [(r["chunk"], bytes(r["levels"])) for r in levels]))
        lists = self.scratch.put(classes.select("id", "sig").mapInArrow(_post(cast, K - self.least + 1), "key long, id long, hot boolean"), "lists")
        cast.destroy()
        return lists

    @staticmethod
    def _short_pairs(lists: DataFrame) -> DataFrame:
        short = lists.filter("not hot").groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids")).filter(F.size("ids") > 1)
        pairs = short.select(F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> named_struct('a', x, 'b', y))))")).alias("p"))
        return pairs.select("p.a", "p.b")

    def _sets(self, ids: DataFrame) -> DataFrame:
        """(id, grams) of the rows with these ids.  The ids may be many: they are never broadcast."""
        texts = self.documents.withColumnRenamed("doc_id", "id").join(ids.hint("merge"), "id", "left_semi")
        return self.scratch.put(texts.mapInArrow(_sets(self.shingle), "id long, grams array<long>"), "sets")

    def _room(self, sets: DataFrame, ids: DataFrame) -> DataFrame:
        """(id, least, most) of the classes in hot lists: how many shingles one has, and how many of them another of
        them has as well.  An id with several texts has the least of its sizes and the most, as nothing is known to
        be its own."""
        rare = sets.mapInArrow(_gram_counts, "gram long, n long, id long").groupBy("gram").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
        counted = rare.filter("n = 1").groupBy("id").agg(F.count("*").alias("alone"))
        sizes = self.signed.filter("n_shingles > 0").select(F.col("doc_id").alias("id"), "n_shingles").join(ids, "id", "left_semi")
        sizes = sizes.groupBy("id").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"), F.count("*").alias("rows"))
        most = F.col("most") - F.when(F.col("rows") == 1, F.coalesce("alone", F.lit(0))).otherwise(0)
        return self.scratch.put(sizes.join(counted, "id", "left").select("id", "least", most.cast("long").alias("most")), "room")

    def _met(self, both: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(hub, id, n, n_hub, shared) of pairs (hub, id), and the hubs' sets.  Of an id with several texts, its
        smallest is the hub, each is a row."""
        hubs = sets.join(both.select(F.col("hub").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.size("grams"), "grams")).alias("x"))
        hubs = self.scratch.put(hubs.select(F.col("id").alias("hub"), F.col("x.grams").alias("core")), "hubs")
        joined = both.join(sets, "id").join(hubs, "hub")
        met = joined.select("hub", "id", F.size("grams").alias("n"), F.size("core").alias("n_hub"), F.size(F.array_intersect("grams", "core")).alias("shared"))
        return self.scratch.put(met, "met"), hubs

    def _hubs_of_lists(self, long: DataFrame) -> DataFrame:
        """(hub, id): the classes with the hubs of their hot lists, a hub with itself included."""
        hub = long.groupBy("key").agg(F.min(F.struct(F.col("least") - F.col("most"), "id")).alias("hub")).select("key", F.col("hub.id").alias("hub"))
        return self.scratch.put(long.join(hub, "key").select("hub", "id").distinct(), "both")

    def _moved(self, both: DataFrame, met: DataFrame, room: DataFrame) -> DataFrame:
        """(hub, id) with each hub replaced by the best hub that it has met itself and shares half its shingles with:
        copies of one text whose lists are not all the same then share a hub."""
        own = room.select("id", (F.col("least") - F.col("most")).alias("own"))
        better = met.filter("2 * shared >= n and hub != id").join(both.select(F.col("hub").alias("id")).distinct(), "id", "left_semi").select("hub", "id")
        better = better.join(own.withColumnRenamed("own", "id_own"), "id").join(own.select(F.col("id").alias("hub"), F.col("own").alias("hub_own")), "hub")
        better = better.filter(F.struct("hub_own", "hub") < F.struct("id_own", "id")).groupBy("id").agg(F.min(F.struct("hub_own", "hub")).alias("to")).select(F.col("id").alias("from"), F.col("to.hub").alias("to"))
        better = self.scratch.put(better, "better")
        for _ in range(2):  # twice as far each time; nothing but the size of the groups depends on it
            onward = better.select(F.col("from").alias("to"), F.col("to").alias("onward"))
            better = self.scratch.put(better.join(onward, "to", "left").select("from", F.coalesce("onward", "to").alias("to")), "better")
        moved = both.join(better.withColumnRenamed("from", "hub"), "hub", "left").select(F.coalesce("to", "hub").alias("hub"), "id")
        return self.scratch.put(moved.unionByName(moved.select("hub", F.col("hub").alias("id"))).distinct(), "moved")

    def _agreeing(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        pairs = pairs.distinct()
        left = classes.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
        right = classes.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_agree(self.least), "a long, b long").distinct()

    def _cross_pairs(self, met: DataFrame, hubs: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs across components that met one hub and may be links, one of them outside its largest component."""
        rows = met.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        parts = rows.groupBy("hub", "component").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"))
        mixed = parts.filter("parts > 1").select("hub", F.col("top.component").alias("largest"))
        rows = rows.join(mixed, "hub").select("hub", "id", "n", "shared", "component", (F.col("component") != F.col("largest")).alias("apart"))
        rows = self.scratch.put(rows, "mixed")
        other = lambda df, *columns: df.filter("apart").select(*[F.col(c).alias(f"x_{c}") for c in columns])
        pair = [F.least("id", "x_id").alias("a"), F.greatest("id", "x_id").alias("b")]
        across = F.col("component") != F.col("x_component")
        # Shingles beyond the hub's that classes of several components have.  A link needs so many of them (`need`) that
        # both have one in common among all but the `need` - 1 most frequent of their own: only those are posted.  And
        # behind the first that they share, both must have enough of them left.
        own = rows.select("hub", "id", "component", "apart").distinct().join(sets, "id").join(hubs, "hub")
        own = own.select("hub", "id", "component", "apart", F.size("grams").alias("n"), F.size(F.array_intersect("grams", "core")).alias("shared"), F.explode(F.array_except("grams", "core")).alias("gram"))
        need = (F.ceil(F.lit(self.percent) * F.col("n") / 100) - F.col("shared")).cast("int")
        own = own.groupBy("hub", "id", "component", "apart", "gram").agg(F.min(need).alias("need"), F.min("n").alias("n"), F.max("shared").alias("shared"))
        alike = Window.partitionBy("hub", "gram")
        own = own.withColumns({"low": F.min("component").over(alike), "high": F.max("component").over(alike), "often": F.count("*").over(alike)}).filter("low < high")
        of = Window.partitionBy("hub", "id")
        own = own.withColumns({"rank": F.row_number().over(of.orderBy("often", "gram")), "all": F.count("*").over(of), "need": F.greatest(F.min("need").over(of), F.lit(1)), "n": F.min("n").over(of), "shared": F.max("shared").over(of)})
        own = own.filter("rank <= all - need + 1").select("hub", "id", "component", "apart", "gram", "n", "shared", (F.col("all") - F.col("rank") + 1).alias("left"))
        own = self.scratch.put(own, "own")
        p = self.percent
        enough = (100 + p) * (F.least("left", "x_left") + F.least("shared", "x_shared")) >= p * (F.col("n") + F.col("x_n"))
        by_gram = own.join(other(own, "hub", "gram", "id", "component", "n", "shared", "left"), (F.col("hub") == F.col("x_hub")) & (F.col("gram") == F.col("x_gram")) & across & enough)
        # Or no such shingle: what both share with the hub must do, so neither can be too large for the other.
        cap = F.floor((100 + p) * F.col("shared") / p) - F.col("n")
        band = lambda x: F.floor(F.log(x.cast("double")) / math.log(BAND))
        able = rows.filter((cap >= 1) & (100 * F.col("shared") >= p * F.col("n"))).withColumn("cap", cap).withColumn("band", band(F.col("n")))
        near = other(able, "hub", "id", "n", "shared", "component", "cap")
        # One band more on either side, as logarithms are rounded.
        low, high = band(F.col("x_n") * p / 100) - 1, band(F.col("x_cap")) + 1
        near = near.withColumn("x_band", F.explode(F.when(low <= high, F.sequence(low, high)))).drop("x_cap")
        fits = (100 + p) * F.least("shared", "x_shared") >= p * (F.col("n") + F.col("x_n"))
        by_size = able.join(near, (F.col("hub") == F.col("x_hub")) & (F.col("band") == F.col("x_band")) & across & fits)
        return by_gram.select(*pair).unionByName(by_size.select(*pair)).distinct()

    def _confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs whose full shingle sets are similar enough."""
        joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
        shared = joined.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("i"), (F.size("ga") + F.size("gb")).alias("t"))
        return self.scratch.put(shared.filter(100 * F.col("i") >= self.percent * (F.col("t") - F.col("i"))).select("a", "b").distinct(), "links")


def report(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document row: n_shingles, component_id and whether it is its component's first."""
    return NearDuplicates(documents, shingle, percent).run().withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def filter_documents(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The smallest doc_id of each component, with all columns; rows with a null doc_id stay.

    Of repeated rows with one doc_id, one stays (of several texts under it, the smallest)."""
    run = NearDuplicates(documents, shingle, percent)
    found = run.scratch.put(run.run(), "assigned")
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    kept = documents.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    twice = run.scratch.put(found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__twice")), "twice")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, F.col("doc_id").cast("long") == F.col("__twice"), "left_semi")
    once = kept.join(twice, F.col("doc_id").cast("long") == F.col("__twice"), "left_anti")
    columns = documents.columns
    # Ordered by the text, then by the whole row as JSON, as some types (maps) have no order.
    first = again.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.struct("text", F.to_json(F.struct(*columns)))).alias("__row"))
    return once.unionByName(first.select(*[F.col("__row")[c].alias(c) for c in columns]))
