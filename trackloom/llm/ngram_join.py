"""N-gram Jaccard join by multiple-global-order filtering, and the components of its links.

Documents are sets of distinct shingles of `WORDS` lower-cased words. Two sets whose similarity reaches the threshold share,
under every total order of all shingles, one of the first `n - ceil(t n) + 1` shingles of each. So:

1. Equal sets become one class.
2. Under the first order each class gives its prefix; classes that share a prefix shingle, and may be linked by their sizes
   and its places in the two orders, form a list, and equal lists count once.
3. The members of the lists get their prefixes under `ORDERS` - 1 further orders, as 16-bit hashes. Within a list a pair is
   a candidate only if it shares a prefix hash under each further order as well: the filters are intersected before any
   set is fetched. A bound on the symmetric difference from parity bitmaps, of 1 to 2 bits a shingle, is laid over them.
   None of these ever drops a link. Of the candidates a spanning forest of the likeliest ones is verified on whole sets.
4. Links found join classes to components. Last, every candidate of a list whose ends are still in different components is
   verified. So no link that would join two components is lost, while a group of near copies costs about as many
   verifications as it has members, not their square.

All orders put frequent shingles last, and sort the others by a hash of their own; any order gives the same result.
Frequent shingles are those seen often within single stretches of `CHUNK_TOKENS` shingles; counts over all stretches are
added up and the `HOT_TOKENS` highest go to the executors (a documented bound, 2 MB). Prefixes, bitmaps and sets are made
only for documents that need them; a fixed 2 MB bit filter keeps the others out.

Defined results
* null, blank or empty text: no shingles, linked with nothing. Fewer words than WORDS: the whole sequence is one shingle.
* equal texts are one class and share a component; repeated rows keep their number. Shingles are compared by 64-bit hashes.
* rows of one doc_id with different texts are documents of their own, each with its own links.
* null doc_id: the row is returned with its number of shingles and a null component_id, and takes no part in links.
* ties: a component is named by its smallest doc_id. Empty table: an empty result. Further columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import binary_buffers, bound_batches, cut_lineage, drop_written, mix64, pieces_by_bytes, ragged_index, read_table, span_hashes, text_buffers
from .groups import Likeness, components_of_groups, wanted_bits, wanted_hashes

WORDS = 5
SIMILAR, OUT_OF = 80, 100
CHUNK_TOKENS = 1 << 23
HOT_LOCAL = 2
HOT_LEAST = 32
HOT_TOKENS = 1 << 18
ORDERS = 3
BUCKET_TOKENS = 1 << 21
LEAST_BUCKETS = 1024
WIDE = 4096
#: Bytes of text that are hashed at once, few enough to stay in a processor's cache, and prefix shingles that are sent together.
_PIECE, _SENT = 1 << 18, 1 << 16
#: Bytes of bitmaps that are compared at once.
_COMPARED = 1 << 25

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALTS = mix64(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of texts that lie end to end, first word number of each text and the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    blank = _BLANK[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before, after = np.append(True, blank[:-1]), np.append(blank[1:], True)
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    return span_hashes(low, starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of all texts, sorted within each text; shingles a text)."""
    h, cut = word_hashes(data, offsets)
    per_text = np.diff(cut)
    n, texts = len(h), len(per_text)
    row = np.repeat(np.arange(texts), per_text)
    place = np.arange(n) - np.repeat(cut[:-1], per_text)
    short = (per_text > 0) & (per_text < words)
    gram = np.zeros(n, np.uint64)
    m = max(0, n - words + 1)
    for k in range(words):
        gram[:m] += mix64(h[k : k + m] + _SALTS[k]) * _SALTS[k + words]
    gram = mix64(gram)
    ok = place <= np.repeat(per_text - words, per_text)
    gram, row = gram[ok], row[ok]
    if short.any():
        for i in np.flatnonzero(short):
            whole = np.array([per_text[i]], np.uint64)
            for k in range(int(per_text[i])):
                whole = mix64(whole + mix64(h[cut[i] + k : cut[i] + k + 1] + _SALTS[20 + k]))
            gram, row = np.append(gram, whole), np.append(row, i)
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    return gram[first], np.bincount(row[first], minlength=texts)


def needed_prefix(n: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """Length of the prefix of a set of n under any order; 0 for the empty set."""
    return np.where(n > 0, n - -(-n * similar // OUT_OF) + 1, 0)


def _bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity bitmap of a set of n: the least power of two from n up, 64 at least."""
    return 1 << np.ceil(np.log2(np.maximum(64, n))).astype(np.int64)


def _pieces(batches, column: int):
    for batch in batches:
        data, offsets = text_buffers(batch.column(column))
        for first, last in pieces_by_bytes(offsets, _PIECE):
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))


def _set_hashes(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set: sums over its shingles."""
    edges = np.append(0, np.cumsum(n))
    mixed = mix64(tokens)
    sums = [np.append(np.uint64(0), np.cumsum(x)) for x in (mixed, mix64(mixed + _SALTS[40]))]
    return tuple(x[edges[1:]] - x[edges[:-1]] for x in sums)


def _summaries(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """A row a document (n, two set hashes), and rows of shingles seen HOT_LOCAL times or more in a stretch."""
    import pyarrow as pa

    schema = "doc_id bigint, n bigint, f1 bigint, f2 bigint, tokens binary, counts binary"
    names = schema.replace(",", "").split()[::2]

    def hot(parts):
        every = np.sort(np.concatenate(parts))
        edge = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        count = np.diff(np.append(edge, len(every)))
        often = count >= HOT_LOCAL
        row = [None] * 4 + [every[edge[often]].tobytes(), count[often].astype(np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64()] * 4 + [pa.binary()] * 2)], names)

    def run(batches):
        parts, held = [], 0
        for rows, data, offsets in _pieces(batches, 1):
            tokens, n = shingle_sets(data, offsets, words)
            f1, f2 = _set_hashes(tokens, n)
            none = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), pa.array(_signed(f1)), pa.array(_signed(f2)), none, none], names)
            parts.append(tokens)
            held += len(tokens)
            if held >= CHUNK_TOKENS:
                yield hot(parts)
                parts, held = [], 0
        if held:
            yield hot(parts)

    return _texts(docs, text_col).mapInArrow(run, schema)


def _hot_tokens(summaries: DataFrame) -> np.ndarray:
    """The most frequent shingles, sorted; at most HOT_TOKENS."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t.as_py(), np.int64)), pa.array(np.frombuffer(c.as_py(), np.int64))], ["token", "c"])

    rows = summaries.filter("tokens is not null").select("tokens", "counts").mapInArrow(run, "token bigint, c bigint")
    most = rows.groupBy("token").agg(F.sum("c").alias("c")).filter(F.col("c") >= HOT_LEAST).orderBy(F.desc("c"), "token").limit(HOT_TOKENS)
    return np.sort(np.array([r[0] for r in most.select("token").collect()], np.int64).view(np.uint64))


def _order_key(tokens: np.ndarray, hot: np.ndarray, which: int) -> np.ndarray:
    """Sort keys of the which-th global order: frequent shingles last, else by a hash of the order's own."""
    key = mix64(tokens + _SALTS[50 + which]) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        key |= (hot[at] == tokens).astype(np.uint64) << np.uint64(63)
    return key


def _prefix(tokens: np.ndarray, n: np.ndarray, hot: np.ndarray, which: int, similar: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle number, set number, place) of the prefixes of sets that lie end to end, under the which-th order."""
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((_order_key(tokens, hot, which), row))
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
    inside = place < needed_prefix(n, similar)[row]
    return order[inside], row[inside], place[inside]


def _met(token: np.ndarray, size: np.ndarray, place: np.ndarray, similar: int) -> np.ndarray:
    """Which rows (sorted by token) have another of their token that they may be linked with.

    Of a linked pair's shared prefix shingles look at the first one: what stands before it in either set's order is not shared, so the
    intersection has at most the lesser of what is left of the two sets. Very wide tokens are kept whole.
    """
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    width = np.diff(np.append(starts, len(token)))
    met = np.repeat(width > WIDE, width)
    at, gap = np.flatnonzero(~met), 1
    while True:
        at = at[at + gap < len(token)]
        at = at[token[at + gap] == token[at]]
        if not len(at):
            return met
        both, left = size[at] + size[at + gap], np.minimum(size[at] - place[at], size[at + gap] - place[at + gap])
        near = at[OUT_OF * left >= similar * (both - left)]
        met[near] = met[near + gap] = True
        gap += 1


def _lists(docs: DataFrame, text_col: str, words: int, similar: int, sent_hot, buckets: int) -> DataFrame:
    """Distinct lists of two or more classes (by first set hash) that share a prefix shingle under the first order."""
    import pyarrow as pa

    def prefixes(batches):
        held, n_held = [], 0

        def packed():
            pairs = np.concatenate(held)
            bucket = (mix64(pairs[:, 0] + _SALTS[60]) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((pairs[:, 1], pairs[:, 0], bucket))
            pairs, bucket = pairs[order], bucket[order]
            fresh = np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))
            pairs, bucket = pairs[fresh], bucket[fresh]
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            cuts, raw = (24 * np.append(edge, len(bucket))).tolist(), pairs.tobytes()
            return pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())], ["bucket", "pairs"])

        for _, data, offsets in _pieces(batches, 1):
            tokens, n = shingle_sets(data, offsets, words)
            if not len(tokens):
                continue
            f1, _ = _set_hashes(tokens, n)
            chosen, row, place = _prefix(tokens, n, sent_hot.value, 0, similar)
            pairs = np.empty((len(chosen), 3), np.uint64)
            pairs[:, 0], pairs[:, 1] = tokens[chosen], f1[row]
            pairs[:, 2] = n[row].astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
            held.append(pairs)
            n_held += len(pairs)
            if n_held >= _SENT:
                yield packed()
                held, n_held = [], 0
        if n_held:
            yield packed()

    def of_bucket(raws):
        pairs = np.frombuffer(b"".join(raws), np.uint64).reshape(-1, 3)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        token, member, size_place = pairs[order].T
        fresh = np.append(True, (token[1:] != token[:-1]) | (member[1:] != member[:-1]))
        token, member = token[fresh], member[fresh]
        size, place = (size_place[fresh] >> np.uint64(32)).astype(np.int64), (size_place[fresh] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        kept = _met(token, size, place, similar)
        token, member = token[kept], member[kept]
        if not len(token):
            return None
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        sizes = np.diff(np.append(starts, len(token)))
        many = sizes > 1
        if not many.any():
            return None
        names = np.add.reduceat(mix64(member + _SALTS[61]), starts)[many]
        starts, sizes = starts[many], sizes[many]
        names, at = np.unique(names, return_index=True)
        starts, sizes = starts[at], sizes[at]
        flat = member[ragged_index(starts, sizes)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(_signed(flat)))
        return pa.RecordBatch.from_arrays([pa.array(_signed(names)), lists], ["list", "members"])

    def lists(batches):
        last, raws = None, []
        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != last and raws:
                    found = of_bucket(raws)
                    if found is not None:
                        yield found
                    raws = []
                last = bucket
                raws.append(raw)
        found = of_bucket(raws) if raws else None
        if found is not None:
            yield found

    packed = _texts(docs, text_col).mapInArrow(prefixes, "bucket int, pairs binary")
    grouped = packed.repartition("bucket").sortWithinPartitions("bucket")
    return grouped.mapInArrow(lists, "list bigint, members array<bigint>").dropDuplicates(["list"])


def _parity_maps(tokens: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Of each set the parities of its shingles by hash."""
    bits = _bits(n)
    at = np.cumsum(bits) - bits
    row = np.repeat(np.arange(len(n)), n)
    flips = np.bincount(at[row] + (mix64(tokens) & (bits[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(bits.sum())) & 1
    packed = np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()
    cuts = (np.append(at, bits.sum()) // 8).tolist()
    return [packed[a:b] for a, b in zip(cuts, cuts[1:])]


def _prefix_hashes(tokens: np.ndarray, n: np.ndarray, hot: np.ndarray, similar: int) -> list[bytes]:
    """Of each set the 16-bit hashes of its prefixes under the further orders, one after the other."""
    short = (mix64(tokens + _SALTS[62]) >> np.uint64(48)).astype(np.uint16)
    each = [short[_prefix(tokens, n, hot, which, similar)[0]].tobytes() for which in range(1, ORDERS)]
    cuts = (2 * np.append(0, np.cumsum(needed_prefix(n, similar)))).tolist()
    return [b"".join(x[a:b] for x in each) for a, b in zip(cuts, cuts[1:])]


class NearSets(Likeness):
    """Sets whose sizes, prefixes under the further orders and parity bitmaps allow the similarity."""

    columns = ("n", "bitmap", "prefixes")

    def __init__(self, similar: int = SIMILAR, orders: int = ORDERS):
        self.similar, self.orders = similar, orders

    def load(self, columns):
        n = columns[0].to_numpy()
        maps, map_offsets = binary_buffers(columns[1])
        prefixes, offsets = binary_buffers(columns[2])
        return [n, (maps, prefixes), map_offsets[:-1], np.diff(map_offsets) // 8, offsets[:-1] // 2]

    def take(self, loaded, rows):
        return [loaded[0][rows], loaded[1], *(x[rows] for x in loaded[2:])]

    def reach(self, loaded):
        return loaded[0], loaded[0] * OUT_OF // self.similar

    def test(self, loaded, i, j):
        ok = self._share_prefixes(loaded, i, j)
        at = np.flatnonzero(ok)
        n = loaded[0]
        differ, both = self._difference(loaded, i[at], j[at]), n[i[at]] + n[j[at]]
        # intersection = (both - difference) / 2, and 100 x intersection >= similar x union
        near = OUT_OF * (both - differ) >= self.similar * (both + differ)
        ok[at[~near]] = False
        return ok, differ[near] / both[near]

    def _share_prefixes(self, loaded, i, j):
        """Whether the prefixes share a hash under each further order; pairs come by i."""
        n, (_, data), _, _, first = loaded
        words, length = data.view(np.uint16), needed_prefix(n, self.similar)
        ok, seen = np.ones(len(i), bool), np.zeros(1 << 16, bool)
        for which in range(self.orders - 1):
            at = np.flatnonzero(ok)
            begin = first + which * length
            edges = np.flatnonzero(np.append(True, i[at][1:] != i[at][:-1])) if len(at) else at
            for a, b in zip(edges.tolist(), np.append(edges[1:], len(at)).tolist()):
                x, y = i[at[a]], j[at[a:b]]
                own = words[begin[x] : begin[x] + length[x]]
                seen[own] = True
                cuts = np.cumsum(length[y]) - length[y]
                ok[at[a:b]] = np.logical_or.reduceat(seen[words[ragged_index(begin[y], length[y])]], cuts)
                seen[own] = False
        return ok

    def _difference(self, loaded, i, j):
        """A lower bound of the symmetric difference: parities that differ, the wider bitmap folded to the narrower one."""
        _, (data, _), start, width, _ = loaded
        words, out = data.view(np.uint64), np.zeros(len(i), np.int64)
        for wi, wj in {*zip(width[i].tolist(), width[j].tolist())}:
            rows = np.flatnonzero((width[i] == wi) & (width[j] == wj))
            step, least = max(1, _COMPARED // (8 * max(wi, wj))), min(wi, wj)
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                x, y = (_fold(words[(start[e[some]] // 8)[:, None] + np.arange(w)], least) for e, w in ((i, wi), (j, wj)))
                out[some] = np.bitwise_count(x ^ y).sum(axis=1)
        return out


def _fold(words: np.ndarray, level: int) -> np.ndarray:
    """Rows of 64-bit bitmap words, folded to `level` words by exclusive-or."""
    while words.shape[1] > level:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _classes_of(docs: DataFrame, text_col: str, words: int, homes: DataFrame, wanted: DataFrame, schema: str, columns) -> DataFrame:
    """A row (f1, ...) a wanted class: `columns` makes Arrow columns of (shingles, sizes). homes: doc_ids (id) in which the classes (wanted: f1) occur."""
    import pyarrow as pa

    bits = docs.sparkSession.sparkContext.broadcast(wanted_bits(homes))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            here = wanted_hashes(bits.value, batch.column(0).to_numpy(zero_copy_only=False))
            for _, data, offsets in _pieces([batch.filter(pa.array(here))], 1):
                tokens, n = shingle_sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(_set_hashes(tokens, n)[0])), *columns(tokens, n)], names)

    source = _texts(docs, text_col).filter("doc_id is not null")
    return source.mapInArrow(run, schema).dropDuplicates(["f1"]).join(wanted.select("f1"), "f1", "left_semi")


def _verified(docs: DataFrame, text_col: str, words: int, similar: int, pairs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(of the pairs (a, b) of classes those that reach the threshold, the sets fetched for them, to be deleted)."""
    import pyarrow as pa

    ends = pairs.select(F.col("a").alias("f1")).unionByName(pairs.select(F.col("b").alias("f1"))).distinct()
    homes = ends.join(classes, "f1").select(F.col("home").alias("id"))

    def sets(tokens, n):
        raw, cuts = tokens.tobytes(), (8 * np.append(0, np.cumsum(n))).tolist()
        return [pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())]

    def check(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and OUT_OF * both >= similar * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = cut_lineage(_classes_of(docs, text_col, words, homes, ends, "f1 bigint, tokens binary", sets))
    joined = pairs.join(found.select(F.col("f1").alias("a"), F.col("tokens").alias("x")), "a").join(found.select(F.col("f1").alias("b"), F.col("tokens").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"), found


def _components(docs: DataFrame, text_col: str, words: int, similar: int) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n, f1, f2; classes: f1, f2, home (the smallest doc_id) and comp, the smallest f1 of the component)."""
    import pyarrow as pa

    spark = docs.sparkSession
    bound_batches(spark)
    summaries = cut_lineage(_summaries(docs, text_col, words))
    own = summaries.filter("n is not null").drop("tokens", "counts")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sent_hot = spark.sparkContext.broadcast(_hot_tokens(summaries))
    classes = cut_lineage(own.filter("doc_id is not null and n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("home")))
    lists = cut_lineage(_lists(docs, text_col, words, similar, sent_hot, max(LEAST_BUCKETS, total // BUCKET_TOKENS)))
    flat = lists.select("list", F.size("members").alias("m"), F.explode("members").alias("f1"))
    wanted = cut_lineage(flat.select("f1").distinct().join(classes, "f1").select("f1", F.col("home").alias("id")))

    def payload(tokens, n):
        maps, prefixes = _parity_maps(tokens, n), _prefix_hashes(tokens, n, sent_hot.value, similar)
        return [pa.array(n.astype(np.int64)), pa.array(maps, pa.binary()), pa.array(prefixes, pa.binary())]

    payloads = _classes_of(docs, text_col, words, wanted.select("id"), wanted, "f1 bigint, n bigint, bitmap binary, prefixes binary", payload)
    members = cut_lineage(flat.join(payloads, "f1").withColumnRenamed("f1", "id"))
    drop_written(spark, lists, wanted)

    def verify(pairs: DataFrame) -> DataFrame:
        good, sets = _verified(docs, text_col, words, similar, pairs, classes)
        good = cut_lineage(good)
        drop_written(spark, sets)
        return good

    found = components_of_groups(members, NearSets(similar), verify)
    drop_written(spark, members)
    if found is None:
        return own, classes.withColumn("comp", F.col("f1"))
    return own, classes.join(found.withColumnRenamed("id", "f1"), "f1", "left").withColumn("comp", F.coalesce("component", "f1")).drop("component")


def similar_documents(docs: DataFrame, text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of `docs`."""
    own, classes = _components(docs, text_col, words, similar)
    first = classes.groupBy("comp").agg(F.min("home").alias("c"))
    named = classes.join(first, "comp").select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), "c")
    joined = own.join(named, (own.f1 == named.c1) & (own.f2 == named.c2) & (own.n > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_each(docs: DataFrame, text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """One row of each component: of its smallest doc_id; of several texts or rows of that doc_id the first by hash of the set, then of the
    whole row. Rows without id or without words stay, but for repetitions of a whole row with an id."""
    import pyarrow as pa

    _, classes = _components(docs, text_col, words, similar)
    first = classes.groupBy("comp").agg(F.min(F.struct("home", "f1")).alias("x")).select(F.col("x.home").alias("kept_id"), F.col("x.f1").alias("kept_set"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index(text_col)

    def hashed(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0).field(at).cast(pa.string()))
            parts = [_set_hashes(*shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words))[0] for a, b in pieces_by_bytes(offsets, _PIECE)]
            f1 = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(f1))], ["row", "f1"])

    rows = whole.mapInArrow(hashed, StructType([*whole.schema.fields, StructField("f1", LongType())]))
    rows = rows.withColumn("id", F.col("row.doc_id").cast("long"))
    alone = rows.filter("id is null")
    kept = rows.filter("id is not null").join(first, (F.col("id") == F.col("kept_id")) & (F.col("f1") == F.col("kept_set")), "left")
    kept = kept.filter("f1 = 0 or kept_id is not null")  # 0: no shingles
    whole_row = F.xxhash64("row")
    kept = kept.groupBy("id", "f1", F.when(F.col("f1") == 0, whole_row).alias("other")).agg(F.min_by("row", whole_row).alias("row"))
    return kept.select("row.*").unionByName(alone.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read_table(spark, sf_dir, "documents"))
