"""MinHash near-duplicates by an inverted join over signature coordinates.

Every document becomes the set of its word shingles and a signature of COORDS minima. Equal sets collapse into one class
at once. Classes are posted under (coordinate, value) tokens. Two sets of similarity 0.8 agree in 51 of 64 coordinates on average; a
pair counts as a candidate from MATCHES = 36 collisions on (a pair of similarity 0.8 falls short with a chance of 3e-6, one of
0.85 with 1e-9). Two classes that collide in 36 of 64 lists share one of their 29 shortest lists, so only that prefix
is posted; tokens of one class, and classes with too few shared tokens, are skipped before that. Collisions are counted on
posted lists; the long lists behind them are skipped, and only probed for pairs that collide in the prefix, through their signatures.

A group of n near copies would give n * n pairs, so pairs are taken in two steps. First each class meets the first one
of the lists on which it is posted, that with the most collisions. What this links is merged, and then only
classes from different merged groups that share a posting are compared, in blocks of two chunks within tasks: in every block, of
two classes or of hundreds, collisions are counted, pairs from MATCHES on are confirmed on full sets, and at most a link for each
merged group comes out. A pair is taken in one group only, that of the first list that both are on. Links inside a
merged group change no result. All links are confirmed on full sets.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import drop_stored, free_worker_tables, join_dealt, small_side, stored

COORDS, MATCHES = 64, 36
#: A chunk holds about so many classes, and about so many shingles, at most; a class with more is a chunk by chance with few others.
CHUNK, CHUNK_SHINGLES = 384, 1_000_000
_BLOCK = 2048


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text; shorter texts have one shingle, texts without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ each[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_101)
    return draw.integers(0, 2**64, COORDS, np.uint64) | np.uint64(1), draw.integers(0, 2**64, COORDS, np.uint64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(COORDS, 2**32 - 1, np.uint64)
    for k in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, ((hashes[k : k + _BLOCK, None] * a + b) >> np.uint64(32)).min(axis=0))
    return least.astype(np.uint32)


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h (hash of the text), n_shingles, key (digest of the whole set), sig."""

    def run(batches):
        free_worker_tables()
        a, b = _coefficients()
        for batch in batches:
            out = ([], [], [])
            for text in batch.column(2):  # one at a time
                own = shingle_set(text.as_py(), width)
                out[0].append(len(own))
                out[1].append(xxhash.xxh3_128_digest(own.tobytes()))
                out[2].append(signature(own, a, b).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["id", "h", "n_shingles", "key", "sig"])

    return docs.select(F.col(id_col).cast("long"), _text_key(text_col), F.col(text_col)).mapInArrow(run, "id long, h long, n_shingles long, key binary, sig binary")


def _text_key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _tokens(reps: DataFrame) -> DataFrame:
    """A row for each coordinate of each signature; token holds coordinate and value."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDS)
                token = (np.arange(COORDS, dtype=np.int64) << 32) | sig.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), COORDS))], ["token", "node"])

    return reps.select("node", "sig").mapInArrow(run, "token long, node long")


def postings(reps: DataFrame) -> DataFrame:
    """token, df (classes with the token), node, n_shingles: the prefix under which each class is posted."""
    tokens = stored(_tokens(reps), "tokens")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    lists = tokens.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own")).where(F.size("own") >= MATCHES)
    prefix = lists.select("node", F.explode(F.slice("own", F.lit(1), F.size("own") - (MATCHES - 1))).alias("t")).select("node", F.col("t.token").alias("token"), F.col("t.df").alias("df"))
    out = stored(prefix.join(reps.select("node", "n_shingles"), "node"), "postings")
    drop_stored(tokens)
    return out


def _fits(a, b, percent: int):
    """Sets so unequal in size that they can't be linked are out."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _confirmed(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], reps: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that collide often enough and whose full sets are similar enough."""

    def agree(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, COORDS) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((left == right).sum(axis=1) >= MATCHES))

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = _shared(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def with_both(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
        """Each pair with what is `name` of its two nodes; a node that many pairs name, as the first of a large group, is sent to many tasks."""
        left, right = of.select(F.col("node").alias("a"), F.col(name).alias("x")), of.select(F.col("node").alias("b"), F.col(name).alias("y"))
        weights = pairs.groupBy("a").agg(F.count("*").alias("_w"))
        return join_dealt(pairs, left, "a", weights, "b").join(right, "b").select("a", "b", "x", "y")

    pairs = stored(pairs, "pairs")
    asked = small_side(stored(_nodes(pairs), "asked"))
    likely = stored(with_both(pairs, reps.join(asked, "node", "left_semi"), "sig").mapInArrow(agree, "a long, b long"), "likely")
    sets = sets_of(_nodes(likely))
    out = stored(with_both(likely, sets, "members").mapInArrow(verify, "a long, b long").distinct(), "confirmed")
    for x in (pairs, sets):
        drop_stored(x)
    return out


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest reachable) of every id in links (a, b): alternating large and small stars until nothing changes."""
    edges, state = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct().join(edges.select(F.col("u").alias("id")), "id", "left_anti"))
        state, old = new, edges
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = stored(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for x in (old, large):
            drop_stored(x)


def _links(docs: DataFrame, reps: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame | None:
    """node, component of classes that are linked with another one; None if none is."""
    posted = postings(reps)
    if posted.isEmpty():
        return None

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(2)]
            own = pa.array([xxhash.xxh3_128_digest(x) == key for x, key in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "members"]).filter(own)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """The full sets of these classes, from the text of a document of each; no others are moved. Rows that repeat an id give one set."""
        asked = stored(reps.join(nodes, "node").select(F.col("rep").alias("id"), "node", "key"), "asked-sets")
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(small_side(asked), "id").select("node", "key", "text")
        return stored(texts.mapInArrow(run, "node long, members binary").dropDuplicates(["node"]), "sets")

    # who is on a list is in the group of that list's first class, together with it
    first = posted.groupBy("token").agg(F.min(F.struct("node", "n_shingles")).alias("first"), F.count("*").alias("_w"))
    met = join_dealt(posted, first.drop("_w"), "token", first.select("token", "_w"), "node").select("node", "n_shingles", F.col("first.node").alias("pivot"), F.col("first.n_shingles").alias("np"))
    met = stored(met.groupBy("node", "n_shingles", "pivot", "np").agg(F.count("*").alias("collisions")), "met")
    stars = met.where("pivot < node").where(_fits(F.col("n_shingles"), F.col("np"), percent)).groupBy(F.col("node").alias("b")).agg(F.max_by("pivot", F.struct("collisions", -F.col("pivot"))).alias("a"))
    links = _confirmed(stars.select("a", "b"), sets_of, reps, percent)
    merged = stored(components(links), "merged")
    members = stored(met.select("pivot", "node", "n_shingles").join(merged.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")), "members")
    more = _in_blocks(members, reps, sets_of, percent)
    out = stored(components(stored(links.unionByName(more), "all-links")).withColumnRenamed("id", "node"), "components")
    for x in (posted, met, merged, members):
        drop_stored(x)
    return out


def _chunks(members: DataFrame, percent: int) -> DataFrame:
    """pivot, node, component, band, single, part, n: members of groups with several components, dealt to chunks.

    A band holds the sizes within a factor of percent, so that links are within a band or from one to the next. Large
    components have chunks of their own, of which no two are compared.
    """
    groups = members.groupBy("pivot").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("pivot")
    own = members.join(small_side(stored(groups, "groups")), "pivot", "left_semi").withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n_shingles"))
    sizes = own.groupBy("pivot", "component").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK // 4).select("pivot", "component", F.col("component").alias("single"))
    own = own.join(small_side(stored(sizes, "large")), ["pivot", "component"], "left").withColumn("single", F.coalesce("single", F.lit(-1)))
    counts = own.groupBy("pivot", "single", "band").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).cast("long").alias("parts"))
    many = small_side(stored(counts.where("parts > 1"), "many"))  # the others are one chunk
    dealt = own.join(many, ["pivot", "single", "band"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0).cast("long")))
    return stored(dealt.select("pivot", "node", "component", "band", "single", "part"), "dealt")


_SPOT = ["single", "band", "part"]


def _colliding(left: list, right: list, percent_of: Callable | None, same: bool) -> list[tuple[int, int]]:
    """Places (i, j) of pairs of different components that collide in MATCHES coordinates at least, and are in no earlier common group."""
    sig = [np.frombuffer(b"".join(x["sig"] for x in side), np.uint32).reshape(-1, COORDS) for side in (left, right)]
    component = [np.array([x["component"] for x in side]) for side in (left, right)]
    prefix = np.zeros((len(left), len(right)), np.uint8)
    for k in range(COORDS - MATCHES + 1):  # a pair without a collision here can't come to MATCHES
        prefix += sig[0][:, k, None] == sig[1][:, k]
    i, j = np.nonzero((prefix > 0) & (component[0][:, None] != component[1]))
    out: list[tuple[int, int]] = []
    for k in range(0, len(i), 100_000):
        a, b = i[k : k + 100_000], j[k : k + 100_000]
        enough = prefix[a, b].astype(np.int64) + (sig[0][a, COORDS - MATCHES + 1 :] == sig[1][b, COORDS - MATCHES + 1 :]).sum(axis=1) >= MATCHES
        out += zip(a[enough].tolist(), b[enough].tolist(), strict=True)
    if same:
        out = [(x, y) for x, y in out if x < y]
    return [(x, y) for x, y in out if percent_of is None or percent_of(left[x], right[y])]


def _blockwise(rows: DataFrame, work: Callable[[tuple, list, list, bool], list[tuple]], schema: str) -> DataFrame:
    """work(key, left rows, right rows, whether both sides are one chunk) of each block. Blocks are streamed in sorted order, one at a time."""
    key = ["pivot", *[f"{k}_{x}" for k in "lr" for x in _SPOT]]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        now, own = None, []

        def done():
            left, right = ([x for x in own if x["side"] == s] for s in "lr")
            out = work(now, left, right or left, not right)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "side" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

        for batch in batches:
            for row in batch.to_pylist():
                at = tuple(row[x] for x in key)
                if at != now:
                    if own:
                        yield done()
                    now, own = at, []
                own.append(row)
        if own:
            yield done()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *key).sortWithinPartitions(*key, "side", "node").mapInArrow(run, schema)


def _in_blocks(members: DataFrame, reps: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links (a, b) between components of each group.

    Any two chunks of a group, of one band or of neighbouring ones, make a block, but two chunks of one large component. First
    collisions are counted on signatures; full sets are then moved of those classes that have a candidate in a block.
    """
    dealt = _chunks(members, percent)
    chunks = dealt.groupBy("pivot", *_SPOT).agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
    left, right = (chunks.select("pivot", *[F.col(x).alias(f"{k}_{x}") for x in _SPOT], F.col("least").alias(f"{k}_least"), F.col("most").alias(f"{k}_most")) for k in "lr")
    spot = lambda k: F.struct(*[f"{k}_{x}" for x in _SPOT])
    other = (F.col("l_single") != F.col("r_single")) | (F.col("l_single") == -1)
    several = F.least("l_least", "r_least") < F.greatest("l_most", "r_most")
    blocks = left.join(right, "pivot").where((spot("l") <= spot("r")) & other & several & (F.abs(F.col("l_band") - F.col("r_band")) <= 1)).drop("l_least", "l_most", "r_least", "r_most")
    blocks = stored(blocks, "blocks")
    sides = [blocks.withColumns({**{x: F.col(f"{k}_{x}") for x in _SPOT}, "side": F.lit(k)}) for k in "lr"]
    asked = sides[0].unionByName(sides[1].where(spot("l") != spot("r")))
    groups_of = members.join(small_side(stored(dealt.select("node").distinct(), "dealt-nodes")), "node", "left_semi").groupBy("node").agg(F.sort_array(F.collect_set("pivot")).alias("pivots"))
    known = stored(reps.select("node", "sig").join(groups_of, "node"), "signed-nodes")
    rows = stored(dealt.join(asked, ["pivot", *_SPOT]).drop(*_SPOT).join(known, "node"), "rows")

    def first_common(now: int) -> Callable:
        return lambda x, y: min(set(x["pivots"]).intersection(y["pivots"])) == now

    def candidates(now: tuple, left: list, right: list, same: bool) -> list[tuple]:
        found = _colliding(left, right, first_common(now[0]), same)
        active = {("l", left[i]["node"]) for i, _ in found} | {("l" if same else "r", right[j]["node"]) for _, j in found}
        return [(*now, s, node) for s, node in sorted(active)]

    def link(now: tuple, left: list, right: list, same: bool) -> list[tuple]:
        sets = [[np.frombuffer(x["members"], np.uint64) for x in side] for side in (left, right)]
        up: dict[int, int] = {}
        out = []

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                x = y
            return x

        found = [(i, j) for i, j in _colliding(left, right, first_common(now[0]), same)]
        dense = _both(sets, same) if len(found) > 2000 else None
        for i, j in found:
            x, y = find(left[i]["component"]), find(right[j]["component"])
            n = len(sets[0][i]) + len(sets[1][j])
            if x == y or 100 * min(len(sets[0][i]), len(sets[1][j])) < percent * max(len(sets[0][i]), len(sets[1][j])):
                continue
            both = int(dense[i, j]) if dense is not None else _shared(sets[0][i], sets[1][j])
            if 100 * both >= percent * (n - both):
                up[max(x, y)] = min(x, y)
                out.append((left[i]["node"], right[j]["node"]))
        return out

    spots = ", ".join(f"{k}_{x} long" for k in "lr" for x in _SPOT)
    active = stored(_blockwise(rows, candidates, f"pivot long, {spots}, side string, node long"), "active")
    on = ["pivot", *[f"{k}_{x}" for k in "lr" for x in _SPOT], "side", "node"]
    sets = sets_of(active.select("node").distinct())
    out = stored(_blockwise(rows.join(active, on, "left_semi").join(sets, "node"), link, "a long, b long").distinct(), "block-links")
    for x in (dealt, blocks, known, rows, active, sets):
        drop_stored(x)
    return out


def _both(sets: list[list[np.ndarray]], same: bool) -> np.ndarray:
    """How many shingles each two sets share: products of incidence matrices over the shingles that stand on both sides."""
    flat = [np.concatenate(x) for x in sets]
    if same:
        values, n = np.unique(flat[0], return_counts=True)
        shared = values[n > 1]
    else:
        shared = np.intersect1d(*flat)
    owner = [np.repeat(np.arange(len(x)), [len(m) for m in x]) for x in sets]
    both = np.zeros((len(sets[0]), len(sets[1])), np.float32)
    for k in range(0, len(shared), _BLOCK):
        part, grid = shared[k : k + _BLOCK], []
        for values, at, x in zip(flat, owner, sets, strict=True):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            ok = part[place] == values
            grid.append(np.zeros((len(x), len(part)), np.float32))
            grid[-1][at[ok], place[ok]] = 1
        both += grid[0] @ grid[1].T
    return both


def _classified(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, h, n_shingles, component_id, group of every row of docs with an id. group names the component; it is null of rows that are alone in theirs."""
    docs = docs.where(F.col(id_col).isNotNull())
    signed = stored(signatures(docs, width, id_col, text_col), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("_w"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    reps = stored(classes.withColumn("node", F.monotonically_increasing_id()), "reps")
    linked = _links(docs, reps, width, percent, id_col, text_col)
    own = reps.select("key", "rep", "_w", "node")
    own = own.withColumn("component", F.lit(None).cast("long")) if linked is None else own.join(linked, "node", "left")
    own = stored(own.where("component is not null or _w > 1").select("key", "_w", "rep", F.coalesce("component", "node").alias("group")), "class-groups")
    least = own.groupBy("group").agg(F.min("rep").alias("component_id"), F.count("*").alias("_w"))
    named = stored(join_dealt(own, least.drop("_w"), "group", least.select("group", "_w"), "key").select("key", "_w", "group", "component_id"), "classes")
    rows = join_dealt(signed.select("id", "h", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key")), named.drop("_w"), "key", named.select("key", "_w"), "id", "left")
    return rows.select("id", "h", "n_shingles", F.coalesce("component_id", "id").alias("component_id"), "group")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept (the smallest id of each component stays).

    Links: 100 * shared shingles >= percent * shingles of both; links carry over. Null and empty texts have no
    shingles and are linked with nothing. Ids are whole numbers; rows without one are left out. Rows that repeat an id with
    another text are documents of their own under that id. Other columns of docs are ignored. An empty table gives an empty result.
    """
    found = _classified(docs, width, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, of each component one row: that with the smallest id, and of those with one id that with the smallest hash of its text.

    It goes by row, not by id: other rows of an id stay if their text is in no component with a smaller one. Rows without an id
    count behind all others. Rows without shingles all stay. Of rows alike in id and text the smallest by all columns stays.
    """
    last = F.lit(2**63 - 1)
    found = _classified(docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.col(text_col).alias("text")), width, percent, "id", "text")
    found = stored(found.where("group is not null").select("id", "h", "group"), "in-groups")
    first = found.groupBy("group").agg(F.min(F.struct("id", "h")).alias("first"), F.count("*").alias("_w"))
    marked = join_dealt(found, first.drop("_w"), "group", first.select("group", "_w"), "id").select("id", "h", (F.struct("id", "h") == F.col("first")).alias("stays"))
    mark = uuid.uuid4().hex  # names that docs doesn't have
    gone, text, stays = (f"{x}_{mark}" for x in ("id", "h", "stays"))
    marked = stored(marked.groupBy("id", "h").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1").select(F.col("id").alias(gone), F.col("h").alias(text), F.col("stays").alias(stays)), "gone")
    here = (F.coalesce(F.col(id_col).cast("long"), last) == F.col(gone)) & (_text_key(text_col) == F.col(text))
    left = docs.join(small_side(marked.drop(stays)), here, "left_anti")
    again = marked.where(stays).drop(stays)
    if again.isEmpty():
        return left
    row = F.struct(*docs.columns)
    one = docs.join(small_side(again), here).groupBy(gone, text).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return left.unionByName(one.select("row.*"))
