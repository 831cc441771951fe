"""N-gram Jaccard join: documents whose shingle sets have Jaccard similarity of at least 3/4.

1. Every chunk asks how many documents hold each of its shingles (4 hashed bytes each; a collision can
   only make a shingle look more common). Two sets as similar as this share 3/4 of either, so each
   has, among its rarest n - ceil(3n/4) + 1 shingles, one that the other has too: sets whose rarest
   ones are all their own drop out, the others keep those as tokens.
2. Equal sets are one class, known by a number. Classes that share a token meet first against a leader of the
   token, then, as far as they are still in different components, each other in tiles of a token and a size
   band (the larger is at most 4/3 of the smaller). Hashed bitmaps of the sets bound the overlap from above by
   the bits they differ in, inside the tile. A pair belongs to the least token that both sets have. Pairs never become
   rows: a tile's rows that are in some pair fetch their sets, are intersected exactly side by side, and of the links
   only those that join two components are returned, fewer than the rows.
3. Components grow from the links by star contraction, all in DataFrames.

Leaders join large families of near copies without testing all pairs; pairs inside one component need
no test; pairs left are tested in tiles, 16 machine words each. Texts without words, and null texts, have no
set and link with nothing. Fewer words than a shingle are one shingle. Long texts have large sets and are
treated alike. Repeated rows and null ids are members like others: a component's id is its smallest id that is not
null. Other columns are not read and may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed, written
from .exchange import answered, asked, by_doc, dealt, parted, rows, served
from .words import U, chunks, inside_docs, join_hash, mix, ngram_hashes

N = 5
BITS = 1024
#: Rounds of leaders. After the fewest they go on while bitmap tests left in tiles are more than this many per row.
MIN_ROUNDS, MAX_ROUNDS = 2, 8
TESTS_PER_ROW = 1024
#: Rows of a token that make a block; a tile is a pair of blocks. Rows of tiles handled in one call, about.
BLOCK = 1024
CALL_ROWS = 8192
#: Tasks that the classes of one component are dealt to.
SALTS = 32
#: Bits of all rows of a tile that are compared at once (8 MB).
BITS_AT_ONCE = 1 << 26
#: Bytes of sets that make a block of a tile's rows for the exact test (a larger set is a block), and that one call takes, about.
SET_BYTES = 16 << 20


def shingle_sets(texts, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents, document bounds)."""
    out, sizes = [], []
    for _, _, words in chunks(texts, lower=True):
        h, off = words.hashes(), words.offsets
        doc = words.doc_of_word()
        grams = ngram_hashes(h, n)
        ok = inside_docs(off, n, len(h))[: len(grams)]
        key, owner = [grams[ok]], [doc[: len(grams)][ok]]
        for d in np.flatnonzero((words.counts > 0) & (words.counts < n)):
            whole = U(words.counts[d])
            for x in h[off[d]: off[d + 1]]:
                whole = join_hash(np.array([whole]), np.array([x]), 7)[0]
            key.append(np.array([whole]))
            owner.append(np.array([d]))
        key, owner = np.concatenate(key), np.concatenate(owner)
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])] if len(key) else np.zeros(0, bool)
        out.append(key[new])
        sizes.append(np.bincount(owner[new], minlength=len(off) - 1))
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return flat, np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int64) if sizes else np.zeros(1, np.int64)


def _class_of(flat: np.ndarray, bounds: np.ndarray) -> list:
    """16 bytes that name a set: two sums of mixed hashes, and none for an empty set."""
    def sums(salt):
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mix(flat ^ U(salt)), out=total[1:])
        return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    pair = np.stack([sums(0x5851F42D4C957F2D), sums(0x14057B7EF767814F)], 1)
    return [pair[i].tobytes() if bounds[i + 1] > bounds[i] else None for i in range(len(bounds) - 1)]


def _bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(BITS, bool)
    bits[(mix(s) % U(BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of every document; tokens, bitmap and shingles of sets that may have a partner."""
    docs, parts = dealt(docs)

    def ask(table: pa.Table) -> pa.Table:
        flat, _ = shingle_sets(by_doc(table)["text"])
        rest = ((flat // U(parts)) & U(0xFFFFFFFF)).astype(np.uint32)
        _, to, which = parted(flat, parts)
        return rows(to, table["chunk"][0].as_py(), [rest[i].tobytes() for i in which])

    def serve(bodies: list) -> list:
        sent = [np.frombuffer(b, np.uint32) for b in bodies]
        _, at, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        level = np.minimum(255, np.ceil(8 * np.log2(count))).astype(np.uint8)[at]  # 0: one document
        ends = np.cumsum([len(s) for s in sent])
        return [level[e - len(s): e].tobytes() for s, e in zip(sent, ends)]

    def use(table: pa.Table, answers: dict) -> pa.Table:
        table = by_doc(table)
        flat, bounds = shingle_sets(table["text"])
        level = np.zeros(len(flat), np.uint8)
        _, to, which = parted(flat, parts)
        for part, i in zip(to.tolist(), which):
            level[i] = np.frombuffer(answers[part], np.uint8)
        cls, n = _class_of(flat, bounds), np.diff(bounds)
        prefix = n - -(-3 * n // 4) + 1
        total = np.r_[0, np.cumsum(level == 0)]
        alone = total[bounds[1:]] - total[bounds[:-1]]
        tokens, bitmaps, sets, seen = [], [], [], set()
        for d in range(len(n)):
            s = slice(bounds[d], bounds[d + 1])
            if cls[d] is None or alone[d] >= prefix[d] or cls[d] in seen:
                tokens.append(None), bitmaps.append(None), sets.append(None)
                continue
            seen.add(cls[d])
            rarest = np.lexsort((flat[s], level[s]))[alone[d]: prefix[d]]
            tokens.append(flat[s][rarest].view(np.int64)), bitmaps.append(_bitmap(flat[s])), sets.append(flat[s].tobytes())
        return pa.table({"doc_id": table["doc_id"], "n_shingles": pa.array(n, pa.int64()), "digest": pa.array(cls, pa.binary()),
                         "tokens": pa.array(tokens, pa.list_(pa.int64())), "bitmap": pa.array(bitmaps, pa.binary()), "shingles": pa.array(sets, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return answered(docs, served(asked(docs, ask), serve), use,
                    f"doc_id {kind}, n_shingles long, digest binary, tokens array<long>, bitmap binary, shingles binary")


def _both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("cls").alias(side), F.col(column).alias(f"{column}_{side}"), F.col("n").alias(f"n_{side}")), side)
    return pairs


def may_link(n_x, n_y, x, y) -> np.ndarray:
    """Whether sets of these sizes and bitmaps (rows of 64-bit words) can be similar enough."""
    both = n_x + n_y
    most = (both - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) // 2  # a differing bit is an element of one set only
    return 100 * most >= 75 * (both - most)


def _words(bitmaps) -> np.ndarray:
    return np.frombuffer(b"".join(bitmaps.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose bitmaps allow a link."""
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(may_link(b["n_a"].to_numpy(), b["n_b"].to_numpy(), _words(b["bitmap_a"]), _words(b["bitmap_b"])))).select([0, 1])
    return _both(pairs, sets, "bitmap").select("a", "b", "bitmap_a", "bitmap_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def have_common(lists: pa.ListArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of rows (i, j): whether their lists of longs share an entry. Lists become rows of bits."""
    own, at = np.unique(np.r_[i, j], return_inverse=True)
    mine = lists.take(pa.array(own))
    size = mine.value_lengths().to_numpy()
    _, bit, times = np.unique(mine.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row, bit = np.repeat(np.arange(len(own)), size)[times[bit] > 1], bit[times[bit] > 1]  # others are in one list only
    _, bit = np.unique(bit, return_inverse=True)
    common, width = np.zeros(len(i), bool), max(64, BITS_AT_ONCE // max(1, len(own)))
    for lo in range(0, int(bit.max(initial=-1)) + 1, width):
        here = (bit >= lo) & (bit < lo + width)
        bits = np.zeros((len(own), (width + 63) // 64), np.uint64)
        np.bitwise_or.at(bits, (row[here], (bit[here] - lo) // 64), U(1) << ((bit[here] - lo) % 64).astype(np.uint64))
        bits = bits[:, bits.any(0)]
        for k in range(0, len(i), 1 << 15):
            part = slice(k, k + (1 << 15))
            common[part] |= (bits[at[: len(i)][part]] & bits[at[len(i):][part]]).any(1)
    return common


def met(index: DataFrame, sets: DataFrame, tile_rows: int) -> DataFrame:
    """Rows of tiles that are in a pair of classes with a common token and different roots whose bitmaps allow a link,
    with the later rows of these pairs as bits; every pair in one tile.

    A row stands in its own size band and, as the smaller set, in the next one. The rows of a token are
    dealt into blocks; every two blocks are one tile, so a token's work is spread however many rows it has.
    A row carries its lesser tokens: two rows that share one of them meet there as well, and belong there.
    Rows with large sets are dealt into blocks once more (``sub``), by the bytes of their sets.
    """
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    lists = index.groupBy("cls").agg(F.sort_array(F.collect_list("token")).alias("open"))  # at most a quarter of a set
    rows = (index.select("token", "cls", "n", "c", "root").join(lists, "cls").join(sets.select("cls", "bitmap"), "cls")
            .withColumn("lesser", F.slice("open", 1, F.array_position("open", F.col("token")).cast("int") - 1))
            .withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("lower", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("tile", F.xxhash64("token", _band(F.col("n")) + F.col("lower"), F.least("block", "other"), F.greatest("block", "other")))
            .select("tile", "cls", "n", "root", "bitmap", "block", "lower", (F.col("block") != F.col("other")).cast("int").alias("cross"), "lesser"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("tile").combine_chunks()
        tile, cls, n, root, block, lower, cross = (table[c].to_numpy() for c in ("tile", "cls", "n", "root", "block", "lower", "cross"))
        words = _words(table["bitmap"])
        ends = np.searchsorted(tile, tile, "right")
        left, right = [], []
        for step in range(1, int((ends - np.arange(len(tile))).max())):
            i = np.flatnonzero(ends - step > np.arange(len(tile)))
            j = i + step
            ok = (root[i] != root[j]) & (lower[i] + lower[j] < 2) & ((cross[i] == 0) | (block[i] != block[j]))
            ok &= 4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])
            i, j = i[ok], j[ok]
            ok = may_link(n[i], n[j], words[i], words[j])
            left.append(i[ok]), right.append(j[ok])
        left, right = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        lesser = table["lesser"].combine_chunks()
        mine = np.ones(len(left), bool)
        first = np.flatnonzero(np.r_[True, ends[left][1:] != ends[left][:-1]]) if len(left) else []
        for lo, hi in zip(first, [*first[1:], len(left)]):  # tile by tile
            mine[lo:hi] = ~have_common(lesser, left[lo:hi], right[lo:hi])
        left, right = left[mine], right[mine]
        out = [(tile[:0],) * 4 + ([],)]
        first = np.flatnonzero(np.r_[True, ends[left][1:] != ends[left][:-1]]) if len(left) else []
        for lo, hi in zip(first, [*first[1:], len(left)]):
            out += _as_rows(tile[left[lo]], left[lo:hi], right[lo:hi], n)
        at = np.concatenate([x[2] for x in out])
        columns = [np.concatenate([x[c] for x in out]) for c in (0, 1, 3)]
        trimmed()
        return pa.table({"tile": columns[0], "sub": columns[1], "at": columns[2], "cls": cls[at], "root": root[at], "n": n[at],
                         "near": pa.array([b for x in out for b in x[4]], pa.binary())})

    return (rows.groupBy(F.pmod("tile", F.lit(tile_rows // CALL_ROWS + 1)).alias("call"))
            .applyInArrow(run, "tile long, sub long, at long, cls long, root long, n long, near binary"))


def _as_rows(tile: int, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> list:
    """(tile, sub, row, place, bits) of the rows in these pairs of one tile: the bits are the places of the later rows."""
    own = np.unique(np.r_[left, right])
    bytes_ = 8 * n[own]
    block = np.zeros(int(own[-1]) + 1, np.int64)
    block[own] = (np.cumsum(bytes_) - bytes_) // SET_BYTES
    subs, which = np.unique((block[left] << 20) + block[right], return_inverse=True)
    out = []
    for k, sub in enumerate(subs):
        i, j = left[which == k], right[which == k]
        member = np.unique(np.r_[i, j])
        near = np.zeros((len(member), len(member)), bool)
        near[np.searchsorted(member, i), np.searchsorted(member, j)] = True
        out.append((np.full(len(member), tile), np.full(len(member), sub), member, np.arange(len(member)), [x.tobytes() for x in np.packbits(near, axis=1)]))
    return out


def joining(sets: list[np.ndarray], root: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ``near`` with intersection of at least 3/4 of the union that join two components, beginning
    from ``root``: with them every linked pair is inside one. Pairs inside one are not tested."""
    size = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(size)[:-1])
    part, mark, out = np.unique(root, return_inverse=True)[1], np.zeros(len(flat), bool), []
    for i in range(len(sets)):
        rest, step = np.flatnonzero(near[i]), 8
        mark[own[i]] = True
        while len(rest := rest[part[rest] != part[i]]):  # a link may spare the others of its component
            some, rest = rest[:step], rest[step:]
            common = np.array([np.count_nonzero(mark[own[j]]) for j in some])
            for j in some[100 * common >= 75 * (size[i] + size[some] - common)].tolist():
                if part[i] != part[j]:
                    out.append((i, j))
                    part[part == part[j]] = part[i]
            step *= 2
        mark[own[i]] = False
    return out


def tiled(index: DataFrame, sets: DataFrame, tile_rows: int) -> DataFrame:
    """Links (a, b) that join the components of the classes in ``index`` as far as all their links do."""
    rows = written(met(index, sets, tile_rows), "op4-met")
    bytes_ = 8 * (rows.agg(F.sum("n")).first()[0] or 0)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tile", "ascending"), ("sub", "ascending"), ("at", "ascending")]).combine_chunks()
        tile, sub, cls, root = (table[c].to_numpy() for c in ("tile", "sub", "cls", "root"))
        first = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (sub[1:] != sub[:-1])])
        pairs = []
        for lo, hi in zip(first, [*first[1:], len(tile)]):
            part = table.slice(lo, hi - lo)
            near = np.frombuffer(b"".join(part["near"].to_pylist()), np.uint8).reshape(hi - lo, -1)
            shingles = [np.frombuffer(x, np.uint64) for x in part["shingles"].to_pylist()]
            pairs += [(lo + i, lo + j) for i, j in joining(shingles, root[lo:hi], np.unpackbits(near, axis=1, count=hi - lo))]
        a, b = (cls[np.array([p[k] for p in pairs], np.int64)] for k in (0, 1))
        del table
        trimmed()
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    # only the sets of rows that are left travel
    own = sets.join(rows.select("cls").distinct(), "cls", "left_semi").select("cls", "shingles")
    return (rows.join(own, "cls").select("tile", "sub", "at", "cls", "root", "near", "shingles")
            .groupBy(F.pmod(F.xxhash64("tile", "sub"), F.lit(bytes_ // SET_BYTES + 1)).alias("call")).applyInArrow(run, "a long, b long"))


def linked(maybe: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``maybe`` with intersection of at least 3/4 of the union."""
    def exact(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):  # views of the batch, not copies
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    maybe = written(maybe, "op4-maybe")
    # only the sets of pairs that are left travel
    ends = maybe.select(F.col("a").alias("cls")).union(maybe.select("b")).distinct()
    return _both(maybe, sets.join(ends, "cls", "left_semi"), "shingles").select("a", "b", "shingles_a", "shingles_b").mapInArrow(exact, "a long, b long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of ``links`` with the smallest node of its component, by large-star and
    small-star steps until nothing changes. Every round is written, so a lost executor redoes one round."""
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    state = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        before, state = state, _digest(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    """Number and combined hashes of distinct edges: equal when a step changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def _band(n):
    return F.floor(F.log(n.cast("double")) / float(np.log(4 / 3))).cast("int")


def class_components(sets: DataFrame) -> DataFrame:
    """(node, root) over linked classes."""
    index = sets.select("cls", "n", F.explode("tokens").alias("token"), F.col("cls").alias("root"))
    roots = None

    for made in range(MAX_ROUNDS + 1):
        if roots:
            index = index.drop("root").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        # leaders by number: the leader of one token is then mostly that of its neighbours too
        open_ = (index.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("cls").alias("lead"), F.min_by("n", "cls").alias("lead_n"),
                                            F.min_by("root", "cls").alias("lead_root"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1"))
        index = written(index.join(open_.drop("r0", "r1"), "token"), "op4-index")
        # every row of a token carries its c: their halves of c - 1 make the c * (c - 1) / 2 pairs
        left = index.agg(F.sum((F.col("c") - 1) / 2).alias("tests"), F.count(F.lit(1)).alias("rows"), F.sum(2 * F.ceil(F.col("c") / BLOCK)).alias("tile_rows")).first()
        if not left["rows"]:
            break
        if made == MAX_ROUNDS or made >= MIN_ROUNDS and left["tests"] <= TESTS_PER_ROW * left["rows"]:
            return components(_more(roots, tiled(index, sets, left["tile_rows"])))
        near = (F.least("n", "lead_n") * 4 >= F.greatest("n", "lead_n") * 3) & (F.col("root") != F.col("lead_root"))
        pairs = index.where(near).select(F.least("lead", "cls").alias("a"), F.greatest("lead", "cls").alias("b")).distinct()
        roots = components(_more(roots, linked(bounded(pairs, sets), sets)))
        # the leaders have met all others of their token
        index = index.where(F.col("lead") != F.col("cls")).drop("c", "lead", "lead_n", "lead_root")
    return roots if roots else sets.select(F.col("cls").alias("node"), F.col("cls").alias("root")).limit(0)


def _more(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    return written(roots.toDF("a", "b").union(links) if roots else links, "op4-links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    every = written(described(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))), "op4-docs")
    # written with their numbers, so that these stay the same whenever they are read
    sets = written(every.where("shingles IS NOT NULL").select("digest", F.col("n_shingles").alias("n"), "tokens", "bitmap", "shingles")
                   .dropDuplicates(["digest"]).withColumn("cls", F.monotonically_increasing_id()), "op4-sets")
    roots = class_components(sets.drop("digest"))
    least = every.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"))
    numbers = sets.select("digest", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    classes = least.join(numbers.select("digest", "root"), "digest", "left")
    # classes without a partner take no part in the join; those of one component, however many, are dealt by salt
    linked_ = classes.where("root IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)))
    names = linked_.groupBy("root").agg(F.min("least").alias("name")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = (linked_.join(names, ["root", "salt"]).select("digest", F.col("name").alias("component_id"))
             .unionByName(classes.where("root IS NULL").select("digest", F.col("least").alias("component_id"))))
    with_words = every.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest").join(named, "digest")
    return (with_words.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .unionByName(every.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (k) WHERE k IN (FROM shared) AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, a FROM e UNION SELECT e.a, r.b FROM r JOIN e ON e.b = r.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id"""
