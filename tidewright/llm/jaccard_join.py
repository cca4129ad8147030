"""N-gram Jaccard join by token-combination prefixes, and the classes of linked documents.

A document's tokens are its distinct word shingles, as 64-bit hashes; documents with equal sets are one set from the
start. Two sets with similarity t or more differ in few tokens, so of a prefix of enough signatures under one global
order at least one is common to both. Rare tokens come first in that order and are signatures by themselves. Frequent
tokens are dealt into classes by hash, and a signature is the combination of all tokens of a set in one class: more
selective than any of them. Prefixes are extended until the signatures outnumber the tokens that may differ.

Sets joined by common signatures, directly or not, form candidate groups. Groups are verified in blocks of bounded
size, exactly, and only enough links to connect what is linked are written.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .components import components
from .store import dropped, in_order, written
from .textkit import packed, unpacked


@dataclass(frozen=True)
class Join:
    """Similarity is percent / 100 of the union.

    counted_share: tokens whose hash lies in this share of all hashes are counted over all documents (sets of up to
    small_set tokens count all theirs, where it only matters that no other set has them). rare: the most sets that hold a rare token. combined: (from this size of set, tokens of a
    class of frequent tokens on average); smaller sets use them singly. block: sets verified together; a set counts once
    for each set_tokens tokens it has, begun ones too, so that a block is bounded in bytes as well.
    """

    words: int = 4
    percent: int = 85
    counted_share: float = 0.2
    small_set: int = 120
    rare: int = 3
    combined: tuple[tuple[int, int], ...] = ((12, 2), (40, 3), (128, 4))
    block: int = 192
    set_tokens: int = 2_000

    @property
    def counted_below(self) -> int:
        """Counted tokens, as bigint, are from 0 to below this."""
        return int(self.counted_share * (1 << 64))

    def one_sided(self, n: np.ndarray) -> np.ndarray:
        """The most tokens of a set of n that a linked set may lack."""
        return n - -(-self.percent * n // 100)

    def differing(self, n: np.ndarray) -> np.ndarray:
        """The most tokens in which a set of n and a linked set may differ, both ways."""
        return (100 - self.percent) * n // self.percent

    def size_class(self, n: np.ndarray) -> np.ndarray:
        """Linked sets are in the same or in neighbouring classes."""
        return np.floor(np.log(np.maximum(n, 1)) / math.log(100 / self.percent) + 1e-9).astype(np.int64)


def shingles(raw: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted inside each, and n + 1 offsets. A shorter text is one shingle."""
    raw = K.LOWER[raw]
    starts, stops, first = K.word_spans(raw, at)
    hashes = K.word_hashes(raw, starts, stops)
    begin, doc = K.inside_texts(first, words)
    tokens = K.window_hashes(hashes, words)[begin] if len(begin) else np.zeros(0, np.uint64)
    count = np.diff(first)
    for width in range(1, words):
        short = np.flatnonzero(count == width)
        if len(short):
            tokens = np.concatenate([tokens, K.mix(K.window_hashes(hashes, width)[first[short]] + np.uint64(width))])
            doc = np.concatenate([doc, short])
    order = np.lexsort((tokens, doc))
    tokens, doc = tokens[order], doc[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])
    tokens, doc = tokens[new], doc[new]
    return tokens, np.searchsorted(doc, np.arange(len(at)))


def _signature(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(K.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return K.signed(K.mix(total[first[1:]] - total[first[:-1]] + K.mix(np.diff(first).astype(np.uint64))))


def _sets(how: Join) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.let_go()
        for rows, raw, at in K.slices(batches, "text"):
            tokens, first = shingles(raw, at, how.words)
            yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("row"), pa.array(np.diff(first)), pa.array(_signature(tokens, first))], ["doc", "row", "n", "sig"])

    return work


def _tokens(how: Join) -> Callable:
    """(token, sig) of counted tokens, of sets that may link with others at all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.let_go()
        for _, raw, at in K.slices(batches, "text"):
            tokens, first = shingles(raw, at, how.words)
            n = np.diff(first)
            each = np.repeat(n, n)
            # A small set's partners may be a little larger, so those show all their tokens too.
            pick = (how.differing(each) > 0) & ((each <= how.small_set * 100 // how.percent + 1) | (tokens < how.counted_below))
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(tokens[pick])), pa.array(np.repeat(_signature(tokens, first), n)[pick])], ["token", "sig"])

    return work


def _signatures(how: Join) -> Callable:
    """(key, rep): the prefix of each set, from its counted tokens that are unique or rare, and the rest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.let_go()
        for rows, raw, at in K.slices(unpacked(batches), "text"):
            tokens, first = shingles(raw, at, how.words)
            keys, reps = [], []
            for k in range(rows.num_rows):
                mine = tokens[first[k] : first[k + 1]]
                n = np.int64(len(mine))
                unique, rare = (np.array(rows.column(c)[k].as_py() or [], np.int64).view(np.uint64) for c in ("unique", "rare"))
                own = _prefix(mine, n, unique, np.sort(rare), how)
                keys.append(own)
                reps.append(np.full(len(own), k))
            keys, reps = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, reps))
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(keys.astype(np.uint64))), rows.column("rep").take(pa.array(reps.astype(np.int64)))], ["key", "rep"])

    return work


def _prefix(tokens: np.ndarray, n: np.int64, unique: np.ndarray, rare: np.ndarray, how: Join) -> np.ndarray:
    """Unique tokens count towards the length but can't be common, so they are not written."""
    need = int(how.differing(n)) + 1 - len(unique)
    if need <= 0:
        return np.zeros(0, np.uint64)
    # A rare token is written for each size class that a linked set may be in, so that only such sets meet.
    sizes = how.size_class(n), how.size_class(n) + 1
    out = [K.mix(rare[:need] ^ K.mix(np.uint64([size + 1]))) for size in sizes]
    rest = need - len(rare)
    if rest > 0:
        frequent = tokens[~np.isin(tokens, np.concatenate([unique, rare]))]
        for size in sizes:
            largest = (100 / how.percent) ** (size + 1)
            tokens_each = max((c for least, c in how.combined if largest >= least), default=0)
            if not tokens_each:
                keys = K.mix(frequent)
            else:
                classes = np.uint64(max(1, int(largest / tokens_each)))
                which = (K.mix(frequent) >> np.uint64(8)) % classes
                order = np.argsort(which, kind="stable")
                which, own = which[order], K.mix(frequent[order] + np.uint64(1))
                starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.zeros(0, np.int64)
                keys = K.mix(np.add.reduceat(own, starts) + K.mix(which[starts] + np.uint64(int(size) << 32))) if len(starts) else which
            out.append(keys[:rest])
            if len(keys) < rest:
                # Too few classes hold tokens. A partner with enough of them is found all the same, as all of this
                # set's signatures are written; two sets that both have too few meet by single tokens.
                out.append(K.mix(tokens[: int(how.differing(n)) + 1] + np.uint64(2)))
    return np.unique(np.concatenate(out))


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """A boolean matrix: which sets are similar enough."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    _, number, count = np.unique(every, return_inverse=True, return_counts=True)
    several = count[number] > 1
    number, owner = number[several], owner[several]
    common = np.zeros((m, m), np.float32)
    _, number = np.unique(number, return_inverse=True)
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    step = 8192
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        a, z = np.searchsorted(number, [lo, lo + step])
        has = np.zeros((m, step), np.float32)
        has[owner[a:z], number[a:z] - lo] = 1
        common += has @ has.T
    common = common.astype(np.int64)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def forest(links: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is linked. Rows with equal `known` (0 or more) are connected already."""
    root = list(range(len(links)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    seen: dict[int, int] = {}
    for k, group in enumerate(known.tolist()):
        if group >= 0:
            root[find(k)] = find(seen.setdefault(group, k))
    out = []
    for a, b in np.argwhere(np.triu(links, 1)).tolist():
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _verify(how: Join, one_side: bool) -> Callable:
    """Links inside a group of rows (rep, z, side, component); with one_side only those across sides."""

    def work(group: pa.Table) -> pa.Table:
        K.let_go()
        unzip = zstandard.ZstdDecompressor()
        raw, at = K.utf8(pa.array([unzip.decompress(z).decode() for z in group.column("z").to_pylist()], pa.large_string()))
        tokens, first = shingles(raw, at, how.words)
        links = linked([tokens[first[k] : first[k + 1]] for k in range(group.num_rows)], how.percent)
        side = group.column("side").to_numpy()
        if one_side:
            links &= side[:, None] != side[None, :]
        _, component = np.unique(group.column("component").to_numpy(), return_inverse=True)
        reps = group.column("rep")
        pairs = forest(links, component if one_side else np.full(len(links), -1))
        return pa.table({"a": reps.take(pa.array([a for a, _ in pairs], pa.int64())), "b": reps.take(pa.array([b for _, b in pairs], pa.int64()))})

    return work


def _links(candidates: DataFrame, texts: DataFrame, groups: DataFrame, near: DataFrame, how: Join) -> DataFrame:
    """Links among candidates (rep, n, free) by their groups (node, component) and the leaders of their signatures: rows
    (a, b) of near say that b, the smallest set with some signature, leads a.

    Each group is laid out by size of set and cut into blocks. First, every block is verified together with the
    group's pivots, the sets with the smallest share of tokens of their own, which are near the middle of their group.
    Then blocks of sets that this left outside the group's largest class are verified against the blocks that share a
    leader with them and hold sets of fitting sizes: only such may hold a link. So a group that hangs together by a
    chain of signatures is verified along the chain, not as all pairs of its blocks.
    """
    weight = F.ceil(F.greatest(F.col("n"), F.lit(1)) / how.set_tokens).alias("_w")
    light = written(candidates.join(groups, F.col("rep") == F.col("node")).select("rep", "n", "free", F.col("component").alias("g"), weight))
    sizes = light.groupBy("g").agg(F.sum("_w").alias("size"))
    by_size = written(in_order(light, ["g", "n", "rep"], {"_rank": "_w"}))
    ends = by_size.groupBy("g").agg(F.min("_rank").alias("_first"), F.sum("_w").alias("size"))
    placed = by_size.join(ends, "g").withColumn("blk", F.floor((F.col("_rank") - F.col("_first")) / how.block))
    by_share = written(in_order(light.join(sizes, "g").where(F.col("size") > how.block).drop("size"), ["g", "free", "rep"], {"_rank": "_w"}))
    pivots = by_share.join(by_share.groupBy("g").agg(F.min("_rank").alias("_first")), "g").where(F.col("_rank") - F.col("_first") < how.block // 3).select("rep", F.lit(True).alias("pivot"))
    placed = written(placed.join(pivots, "rep", "left").select("rep", "n", "g", "size", "blk", F.coalesce("pivot", F.lit(False)).alias("pivot")))
    dropped(light, by_size, by_share)
    rows = placed.where("not pivot").select("rep", "g", "blk").unionByName(placed.where("pivot").select("rep", "g").join(placed.select("g", "blk").distinct(), "g"))
    rows = rows.join(texts, "rep").select("rep", "z", "g", "blk", F.lit(0).alias("side"), F.lit(0).cast("long").alias("component"))
    links = written(rows.groupBy("g", "blk").applyInArrow(_verify(how, False), "a long, b long"))

    state = placed.where(F.col("size") > how.block).join(components(links).select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    state = written(state)
    main = state.groupBy("g", "component").agg(F.count("*").alias("m")).groupBy("g").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    strays = written(in_order(state.join(main, "g").where("component <> main").select("g", "n", "rep", weight), ["g", "n", "rep"], {"_rank": "_w"}))
    strays = strays.join(strays.groupBy("g").agg(F.min("_rank").alias("_first")), "g").select("rep", "g", "n", F.floor((F.col("_rank") - F.col("_first")) / how.block).alias("sblk"))
    ranges = state.groupBy("g", "blk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    stray_ranges = strays.groupBy("g", "sblk").agg(F.min("n").alias("slo"), F.max("n").alias("shi"))
    fits = (F.col("lo") * how.percent <= F.col("shi") * 100) & (F.col("slo") * how.percent <= F.col("hi") * 100)
    # All sets with a signature have the same leader for it, so those that share one share a leader.
    led = near.unionByName(near.select(F.col("b").alias("a"), "b")).distinct().select(F.col("a").alias("rep"), F.col("b").alias("lead"))
    in_block = led.join(state.select("rep", "g", "blk"), "rep").select("lead", "g", "blk").distinct()
    in_stray = led.join(strays, "rep").select("lead", "g", "sblk").distinct()
    sharing = in_block.join(in_stray, ["lead", "g"]).select("g", "blk", "sblk").distinct()
    pairs = written(sharing.join(ranges, ["g", "blk"]).join(stray_ranges, ["g", "sblk"]).where(fits).select("g", "blk", "sblk"))
    left = strays.join(pairs, ["g", "sblk"]).select("rep", "g", "blk", "sblk", F.lit(1).alias("side"))
    right = state.select("rep", "g", "blk").join(pairs, ["g", "blk"]).select("rep", "g", "blk", "sblk", F.lit(0).alias("side"))
    both = left.unionByName(right).join(state.select("rep", "component"), "rep").join(texts, "rep")
    more = both.select("rep", "z", "g", "blk", "sblk", "side", "component").groupBy("g", "blk", "sblk").applyInArrow(_verify(how, True), "a long, b long")
    return written(links.unionByName(more.where("a <> b")))


def _joined(docs: DataFrame, how: Join, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets (doc, row, n, sig), classes (sig, n, doc) of equal sets, and links between classes by sig."""
    key = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    sets = written(texts.mapInArrow(_sets(how), f"doc {key}, row long, n long, sig long"))
    texts = texts.where("doc is not null")
    classes = sets.where("n > 0 and doc is not null").groupBy("sig", "n").agg(F.min(F.struct("doc", "row")).alias("r")).select("sig", "n", F.col("r.doc").alias("doc"), F.col("r.row").alias("row"))
    tokens = texts.select("text").mapInArrow(_tokens(how), "token long, sig long")
    own = tokens.groupBy("token").agg(F.min("sig").alias("sig"), F.max("sig").alias("z")).where("sig = z")
    own = own.groupBy("sig").agg(F.count("*").alias("every"), F.sum(F.col("token").between(0, how.counted_below - 1).cast("long")).alias("counted"))
    most = F.col("n") - F.ceil(F.col("n") * how.percent / 100)
    unshared = F.coalesce(F.when(F.col("n") <= how.small_set, F.col("every")).otherwise(F.col("counted")), F.lit(0))
    able = written(classes.where((100 - how.percent) * F.col("n") >= how.percent).join(own, "sig", "left").where(unshared <= most).select(F.col("sig").alias("rep"), "n", "doc", "row"))
    candidates = written(texts.mapInArrow(packed, f"doc {key}, row long, z binary").join(able.hint("merge"), ["doc", "row"]).select("rep", "n", "z").dropDuplicates(["rep"]))
    dropped(able)

    # As above over all tokens, now that most sets without partners are gone.
    own = candidates.mapInArrow(_rep_tokens(how, True), "token long, rep long").groupBy("token").agg(F.min("rep").alias("rep"), F.max("rep").alias("z")).where("rep = z").groupBy("rep").agg(F.count("*").alias("own"))
    before, candidates = candidates, written(candidates.join(own, "rep", "left").where(F.coalesce("own", F.lit(0)) <= most).drop("own"))
    dropped(before)

    counted = candidates.mapInArrow(_rep_tokens(how, False), "token long, rep long")
    sums = counted.groupBy("token").agg(F.count("*").alias("sets")).where(F.col("sets") <= how.rare)
    kinds = counted.join(sums, "token").groupBy("rep").agg(F.collect_list(F.when(F.col("sets") == 1, F.col("token"))).alias("unique"), F.collect_list(F.when(F.col("sets") > 1, F.col("token"))).alias("rare"))
    kinds = written(candidates.select("rep", "n").join(kinds, "rep", "left").where(F.coalesce(F.size("unique"), F.lit(0)) <= most))
    keys = written(candidates.join(kinds.select("rep", "unique", "rare"), "rep").mapInArrow(_signatures(how), "key long, rep long"))
    leaders = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("z")).where("lead < z").select("key", "lead")
    near = written(keys.join(leaders, "key").where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct())
    dropped(keys)
    groups = components(near)
    share = kinds.select("rep", "n", (F.coalesce(F.size("unique"), F.lit(0)) / F.col("n")).alias("free"))
    links = _links(share, candidates.select("rep", "z"), groups, near, how)
    dropped(near)
    return sets, classes, links


def _rep_tokens(how: Join, every: bool) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.let_go()
        for rows, raw, at in K.slices(unpacked(batches), "text"):
            tokens, first = shingles(raw, at, how.words)
            n = np.diff(first)
            pick = np.ones(len(tokens), bool) if every else tokens < how.counted_below
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(tokens[pick])), rows.column("rep").take(pa.array(np.repeat(np.arange(len(n)), n)[pick]))], ["token", "rep"])

    return work


def shingle_components(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_shingles and component_id, the smallest id that links lead to.

    Exact for the similarity of shingle hashes. Documents without words have no shingles and are their own component,
    as is a row with a null id (component null). Rows with equal ids belong together if their sets do, and each gets
    the component of its own set. Documents of one to three words are one shingle. An empty table gives no rows.
    Other columns are not read. Texts are taken whole.
    """
    sets, classes, links = _joined(docs, how, id_col, text_col)
    found = components(links).select(F.col("node").alias("sig"), "component")
    placed = classes.join(found, "sig", "left").select("sig", F.col("n").alias("_n"), "doc", F.coalesce("component", "sig").alias("component"))
    names = placed.groupBy("component").agg(F.min("doc").alias("name"))
    named = written(placed.join(names, "component").select(F.col("sig").alias("_sig"), "_n", "name"))
    dropped(links)
    out = sets.join(named, (F.col("sig") == F.col("_sig")) & (F.col("n") == F.col("_n")) & F.col("doc").isNotNull(), "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("name", "doc").alias("component_id"))


def first_of_each(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns; nulls and empty texts stay.

    Of rows with equal ids and texts one stays; rows with equal ids and other texts are documents of their own.
    """
    found = written(shingle_components(docs, how, id_col, text_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(id_col) != F.col("component_id")).alias("_gone")))
    gone = found.where("_gone").select("_id").distinct()
    # Merged at every size: ids of copies grow with the documents, and are soon too many to broadcast.
    kept = docs.join(gone.hint("merge"), F.col(id_col) == F.col("_id"), "left_anti")
    repeated = written(found.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id"))
    if repeated.isEmpty():
        return kept
    same = F.col(id_col) == F.col("_id")
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))
