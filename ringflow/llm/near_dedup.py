"""Near-duplicate groups by SuperMinHash.

A document is the set of its distinct 5-word shingles. SuperMinHash (Ertl 2017)
gives each shingle one random permutation of the signature's places; the i-th
place of its permutation is offered a value in [i, i + 1), so values of one
shingle are correlated, the variance is lower than with independent hashes, and
a signature is complete as soon as its largest value lies below the next step.
Signatures are cut in bands, candidates of equal bands are verified on full
sets, and verified links are grouped by union-find.

Documents of equal sets form one class and only its smallest id goes on. In a
bucket of one band, every class is first verified against the bucket's smallest
one, which settles large groups with one link for each member; afterwards only
pairs of different components are compared, over signatures, and those that come
near are verified where they meet, in the first bucket that the pair shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import drop_table, write_table
from ._text import WordHashes, id_text, map_rows, mix, releasing, utf8, window_hashes
from .components import UnionFind, components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair at exactly 0.75 shares none of 32 bands of 4 with probability 5e-6.
BANDS, ROWS = 32, 4
PLACES = BANDS * ROWS
#: Signature agreement below which a pair isn't verified: 0.75 less 5.7 standard deviations of a sketch of 128 bytes.
FLOOR = 0.53
#: Members of a bucket that one task compares; of a larger one every two tiles meet.
TILE = 4096
#: What may be broadcast, in bytes of its rows (hashed they take some four times as many); more is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Bytes of a row: an id or two, a pair's role, an id and text with what belongs to them.
ID, ROLE, KEY = 8, 24, 40
#: Rows of one class that a shuffle by class may bring together; larger classes are few and broadcast.
CLASS_ROWS = 4096
#: Pairs of one leader that are verified in one place.
LEADER_PAIRS = 512
#: Shingles whose permutations are held at once.
TOGETHER = 1 << 16


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a document, given its words' hashes."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < SHINGLE:
        return mix(window_hashes(words, n) + np.uint64(n))
    return np.unique(window_hashes(words, SHINGLE))


def super_minhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures [set, place] as integers step * 2^32 + random 32 bits.

    Shingles are taken TOGETHER at a time, those of one long set in several turns:
    a signature is the minimum over its shingles, and what earlier ones have
    offered stops later ones early.
    """
    h = np.full((len(sets), places), np.iinfo(np.int64).max, np.int64)
    element = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for at in range(0, len(element), TOGETHER):
        part = owner[at : at + TOGETHER]
        _offer(h[part[0] : part[-1] + 1], element[at : at + TOGETHER], part - part[0])
    return h


def _offer(h: np.ndarray, element: np.ndarray, owner: np.ndarray) -> None:
    """Lower the signatures ``h`` by the values of some shingles; step by step for all of them at once."""
    places, flat = h.shape[1], h.reshape(-1)
    perm = np.empty((len(element), places), np.uint8 if places <= 256 else np.int32)
    perm[:] = np.arange(places)
    row = np.arange(len(element))
    for step in range(places):
        # early stop: later steps can't lower a signature whose values all lie below them
        live = (h.max(axis=1) >= step << 32)[owner]
        if not live.all():
            element, owner, perm = element[live], owner[live], perm[live]
            row = np.arange(len(element))
        if not len(element):
            return
        r = mix(element + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        other = step + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(places - step)) >> np.uint64(32)).astype(np.int64)
        place = perm[row, other].astype(np.int64)
        perm[row, other] = perm[:, step]
        value = (np.int64(step) << np.int64(32)) + (r >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, owner * places + place, value)


def sketch(texts: list[str | None], hashes: WordHashes) -> Iterator[tuple[int, bytes | None, bytes | None, list[int] | None]]:
    """Per text: size of its set, the set's 128-bit name, one byte of each signature place, and the band keys."""
    held: list[np.ndarray] = []
    total = 0

    def flush():
        sig = super_minhash([s for s in held if len(s)])
        mixed = mix(sig.astype(np.uint64))
        low = (mixed & np.uint64(0xFF)).astype(np.uint8)
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(sig), axis=0)
        for k in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + mixed[:, k::ROWS])
        key = key.view(np.int64)
        at = 0
        for s in held:
            if len(s):
                yield len(s), xxhash.xxh3_128_digest(s.tobytes()), low[at].tobytes(), key[at].tolist()
                at += 1
            else:
                yield 0, None, None, None

    for text in texts:
        held.append(shingle_set(hashes.of(utf8(text).lower().split())))
        total += len(held[-1])
        if total >= TOGETHER:
            yield from flush()
            held, total = [], 0
    yield from flush()


def sketches(docs: DataFrame) -> DataFrame:
    def make():
        hashes = WordHashes()

        def work(rows: dict) -> dict:
            n, name, sig, bands = zip(*sketch(rows["text"], hashes), strict=True)
            return {"doc_id": rows["doc_id"], "mark": rows["mark"], "n": n, "name": name, "sig": sig, "bands": bands}

        return work

    return map_rows(docs, make, "doc_id long, mark long, n long, name binary, sig binary, bands array<long>")


def hinted(small: DataFrame, row_bytes: int = ID) -> DataFrame:
    """``small``, a table, marked for broadcast if its rows are below the bound in bytes; otherwise the join shuffles."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def ids_of(rows: DataFrame) -> DataFrame:
    return write_table(rows.select("id").distinct(), "ids")


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, shingles) of the given classes (id, doc_id, mark), from a document of each; sorted 64-bit hashes."""

    def make():
        hashes = WordHashes()

        def work(rows: dict) -> dict:
            return {"id": rows["id"], "shingles": [shingle_set(hashes.of(utf8(t).lower().split())).tobytes() for t in rows["text"]]}

        return work

    return map_rows(docs.join(hinted(classes, KEY), ["doc_id", "mark"]).select("id", "text"), make, "id long, shingles binary")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two full sets reach PERCENT."""
    if not 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), written, whose full sets reach PERCENT; every set travels once, to its leader ``a``.

    A leader of many pairs is met in several places, at LEADER_PAIRS each.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_PAIRS).cast("int").alias("k"))
    lead = sizes.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(0).alias("member"))
    rest = pairs.join(sizes, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("salt"), F.lit(1).alias("member"))
    roles = write_table(lead.unionByName(rest), "roles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, leaders = None, []
        for batch in batches:
            out_a, out_b = [], []
            full = batch.column("shingles")
            for i, (a, salt, member, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "member", "id")), strict=True)):
                if (a, salt) != where:
                    where, leaders = (a, salt), []
                own = np.frombuffer(full[i].as_buffer(), np.uint64)
                if not member:
                    leaders.append(own)
                elif any(linked(lead, own) for lead in leaders):
                    out_a.append(a)
                    out_b.append(x)
            yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    met = sets.join(hinted(roles, ROLE), "id").select("a", "salt", "member", "id", "shingles")
    found = write_table(met.repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "id").mapInArrow(releasing(check), "a long, b long"), "verified")
    drop_table(roles)
    return found


class Bucket:
    """Members of one band's bucket (or of two tiles of a very large one) that lie in different components."""

    def __init__(self, key: int, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, bands: np.ndarray, sig: np.ndarray):
        self.key, self.ids, self.n, self.bands, self.sig = key, ids, n, bands, sig
        _, self.comp, count = np.unique(comp, return_inverse=True, return_counts=True)
        # members of the largest component meet all others, which also meet each other
        self.few = np.flatnonzero(self.comp != count.argmax()).tolist()
        self.rank = np.zeros(len(ids), np.int64)
        self.rank[self.few] = np.arange(1, len(self.few) + 1)

    def partners(self, i: int) -> np.ndarray:
        """Members of other components that may be linked with ``i`` and share no earlier bucket with it, most similar first."""
        n = self.n
        other = np.flatnonzero((self.comp != self.comp[i]) & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])) & ((self.rank == 0) | (self.rank > self.rank[i])))
        same = (self.sig[other] == self.sig[i]).mean(axis=1)
        other, same = other[same >= FLOOR], same[same >= FLOOR]
        first = (self.bands[other] == self.bands[i]).argmax(axis=1)
        own = self.bands[i][first] == self.key
        return other[own][np.argsort(-same[own], kind="stable")]


def _buckets(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Call ``work(bucket, rows)`` for each run of equal (key, tiles) in sorted batches."""
    rest = None
    for batch in _then_none(batches):
        if batch is not None:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        elif rest is None:
            return
        else:
            table = rest
        key, tiles = table.column("key").to_numpy(), table.column("tiles").to_numpy()
        edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tiles[1:] != tiles[:-1]), True]) if len(key) else np.zeros(1, np.int64)
        if batch is not None:
            edges = edges[:-1]  # the last run may go on
        if len(edges) > 1:
            done = table.slice(0, int(edges[-1]))
            ids, comp, n = (done.column(c).to_numpy() for c in ("id", "comp", "n"))
            bands = np.array(done.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
            sig = np.frombuffer(b"".join(done.column("sig").to_pylist()), np.uint8).reshape(-1, PLACES)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                out = work(Bucket(key[lo], ids[lo:hi], comp[lo:hi], n[lo:hi], bands[lo:hi], sig[lo:hi]), done.slice(lo, hi - lo))
                if out is not None:
                    yield out
        rest = table.slice(int(edges[-1]) if len(edges) else 0)


def _then_none(items):
    yield from items
    yield None


def in_tiles(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` (key, id, ...) of the buckets in ``sizes`` (key, n), with ``tiles``: one above TILE members is cut, and every two tiles meet."""
    k = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("id"), k).cast("int")
    meets = F.transform(F.sequence(F.lit(0), k - 1), lambda t: F.least(t, own) * k + F.greatest(t, own))
    return rows.join(sizes, "key").withColumn("tiles", F.explode(meets)).drop("n")


def by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "tiles").sortWithinPartitions("key", "tiles", "id")


def prospects(rows: DataFrame) -> DataFrame:
    """(key, tiles, id) of the members that have a partner to be verified there, judged by signatures."""

    def work(bucket: Bucket, part: pa.Table) -> pa.RecordBatch | None:
        needed: set[int] = set()
        for i in bucket.few:
            other = bucket.partners(i)
            if len(other):
                needed.add(i)
                needed.update(other.tolist())
        if not needed:
            return None
        n = len(needed)
        return pa.RecordBatch.from_pydict({"key": pa.array([bucket.key] * n, pa.int64()), "tiles": pa.array([part.column("tiles")[0].as_py()] * n, pa.int32()), "id": pa.array(bucket.ids[sorted(needed)], pa.int64())})

    return by_bucket(rows).mapInArrow(releasing(lambda batches: _buckets(batches, work)), "key long, tiles int, id long")


def cross_links(rows: DataFrame) -> DataFrame:
    """Verified links (a, b) that join components inside buckets; ``rows`` also holds shingles. Union-find skips what a link has already joined, so a bucket gives fewer links than members."""

    def work(bucket: Bucket, part: pa.Table) -> pa.RecordBatch | None:
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")]
        joined, a, b = UnionFind(), [], []
        comp = bucket.comp.tolist()
        for i in bucket.few:
            for j in bucket.partners(i).tolist():
                if joined.find(comp[i]) != joined.find(comp[j]) and linked(full[i], full[j]):
                    joined.union(comp[i], comp[j])
                    a.append(bucket.ids[i])
                    b.append(bucket.ids[j])
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}) if a else None

    return by_bucket(rows).mapInArrow(releasing(lambda batches: _buckets(batches, work)), "a long, b long")


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``group_near_duplicates``, with ``mark``, the hash of the text, and ``again``: a row not kept that repeats id and text of the one that is."""
    d = id_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    rows = write_table(sketches(d).withColumn("row", F.monotonically_increasing_id()), "sketches")
    live = rows.where("n > 0 AND doc_id IS NOT NULL")
    # classes of equal sets, numbered, since an id may stand for several texts; the minimum is taken before the shuffle, so a hot class is one row a task
    classes = live.groupBy("name").agg(F.min(F.struct("doc_id", "row", "mark", "n", "sig", "bands")).alias("x"), F.count("*").alias("rows"))
    classes = write_table(classes.select("name", F.monotonically_increasing_id().alias("id"), "rows", "x.doc_id", "x.row", "x.mark", "x.n", "x.sig", "x.bands"), "classes")
    sketch_of = classes.select("id", "n", "sig", "bands")
    members = classes.select("id", F.explode("bands").alias("key"))
    buckets = write_table(members.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").select("key", "leader"), "buckets")
    crowded = write_table(members.join(buckets, "key"), "members")
    # first links: every class with the leader it shares most bands with
    star = (
        crowded.where("id <> leader").groupBy("id", "leader").count()
        .groupBy("id").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
        .select(F.col("leader").alias("a"), F.col("id").alias("b"))
    )
    star = write_table(star, "pairs")
    needed = classes.select("id", "doc_id", "mark").join(hinted(met_ids := ids_of(crowded)), "id", "left_semi")
    sets = write_table(full_sets(d.where("doc_id IS NOT NULL"), needed).distinct(), "sets")
    links = verify(star, sets)
    # what the leaders left apart: pairs of different components in one bucket
    comp = components(links)
    known = write_table(crowded.join(hinted(comp, 2 * ID), crowded["id"] == comp["node"], "left").select("key", "id", F.coalesce("comp", "id").alias("comp")), "known")
    sizes = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    apart = write_table(in_tiles(known, sizes), "apart")
    sketched = sketch_of.join(hinted(apart_ids := ids_of(apart)), "id", "left_semi")
    near = write_table(prospects(apart.join(sketched, "id")), "near")
    met = apart.join(near, ["key", "tiles", "id"], "left_semi")
    full = sketch_of.join(hinted(near_ids := ids_of(near)), "id", "left_semi").join(sets, "id")
    more = write_table(cross_links(met.join(full, "id")), "verified")
    comp = components(links.unionByName(more))
    # the row that stays for each group of several classes: that of the smallest id
    owner = classes.select("id", "name", "doc_id", "row", "mark", "rows")
    grouped = owner.join(hinted(comp, 2 * ID), owner["id"] == comp["node"])
    first = write_table(grouped.groupBy("comp").agg(F.min(F.struct("doc_id", "name", "row", "mark")).alias("x")).select("comp", "x.doc_id", "x.row", "x.mark"), "first")
    of_node = comp.join(hinted(first, KEY), "comp").select("node", F.col("doc_id").alias("f_id"), F.col("row").alias("f_row"), F.col("mark").alias("f_mark"))
    named = owner.join(of_node, owner["id"] == of_node["node"], "left").where("rows > 1 OR f_id IS NOT NULL").select(
        "name", "rows", F.coalesce("f_id", "doc_id").alias("component_id"), F.coalesce("f_row", "row").alias("stays"), F.coalesce("f_mark", "mark").alias("stays_mark")
    )
    # rows alone in their class and group need nothing from it; a class of many rows isn't brought together by a shuffle
    named = write_table(named, "named")
    # what is left to be read is written by now
    drop_table(classes, buckets, crowded, star, sets, links, more, known, apart, near, first, met_ids, apart_ids, near_ids)
    many = max(CLASS_ROWS, rows.count() * KEY // BROADCAST_BYTES)  # so larger ones are few enough to be broadcast
    side = lambda df, mark: df.select("name", *[F.col(c).alias(f"{mark}_{c}") for c in ("component_id", "stays", "stays_mark")])
    own = rows.select("doc_id", "mark", "n", "name", "row").join(F.broadcast(side(named.where(F.col("rows") > many), "l")), "name", "left")
    alone = F.col("l_stays").isNotNull() | F.col("name").isNull()
    own = own.withColumn("key", F.when(alone, F.unhex(F.hex("row"))).otherwise(F.col("name")))
    own = own.join(side(named.where(F.col("rows") <= many), "s").withColumnRenamed("name", "key"), "key", "left")
    own = own.select("doc_id", "mark", "n", "row", *[F.coalesce(f"l_{c}", f"s_{c}").alias(c) for c in ("component_id", "stays", "stays_mark")])
    # wordless texts have no class: only rows that repeat id and text count as one
    bare = rows.where("n = 0 AND doc_id IS NOT NULL").groupBy("doc_id", "mark").agg(F.min("row").alias("bare_row"), F.count("*").alias("c")).where("c > 1")
    bare = write_table(bare.select(F.col("doc_id").alias("bare_id"), F.col("mark").alias("bare_mark"), "bare_row"), "bare")
    own = own.join(hinted(bare, KEY), (F.col("n") == 0) & (F.col("doc_id") == F.col("bare_id")) & (F.col("mark") == F.col("bare_mark")), "left")
    null_id = F.col("doc_id").isNull()
    out = own.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(~null_id, F.coalesce("component_id", "doc_id")).alias("component_id"),
        (null_id | (F.col("row") == F.coalesce("stays", "bare_row", "row"))).alias("kept"),
        "mark",
        F.coalesce("stays_mark", "mark").alias("stays_mark"),
    )
    return out.withColumn("again", ~F.col("kept") & (F.col("doc_id") == F.col("component_id")) & (F.col("mark") == F.col("stays_mark"))).drop("stays_mark")


def group_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of characters other than ASCII space and \\t to \\r, with A-Z in
    lower case. A text with fewer words than a shingle is one shingle; a null or
    empty text has none and is linked with nothing. component_id is the smallest
    id reachable by links, the row's own included; kept holds for one row of each
    group, one of that id. A row without id takes no part: component_id null, kept
    true. Rows that repeat an id count as one document if they repeat its text too,
    and one of them can be kept; with other texts each follows its own links, and
    an id is no link. Other columns are ignored; an empty table gives an empty result.
    """
    return _grouped(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (columns doc_id, text and any others, whatever their names) with one row of each group, that of the smallest id.

    Rows without id stay, and so do null and empty texts, which are near to nothing;
    of rows that repeat id and text one stays. All other columns are as they were.
    An empty table gives an empty result.
    """
    dropped = write_table(_grouped(docs).where("NOT kept").select("doc_id", "mark", "again").distinct(), "gone")
    gone, again = dropped.where("NOT again"), dropped.where("again")

    def same(keys: DataFrame) -> Column:
        return (docs["doc_id"].cast("long") == keys["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == keys["mark"])

    if not again.limit(1).count():
        return docs.join(hinted(gone, KEY), same(gone), "left_anti")
    # an id and text that several rows repeat: one of them
    repeated = docs.join(hinted(again, KEY), same(again), "left_semi").select(F.struct(*docs.columns).alias("row"))
    by = [F.col("row.doc_id"), F.xxhash64(F.col("row.text").cast("string"))]
    once = repeated.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(by)]).agg(F.first("row").alias("row")).select("row.*")
    return docs.join(hinted(dropped, KEY), same(dropped), "left_anti").unionByName(once)


def oracle_sql() -> str:
    """The same by an inverted list of all shingles; ids that don't repeat."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, array_to_string(ws[i : i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM d WHERE len(ws) >= {SHINGLE})
    UNION ALL SELECT doc_id, 'short ' || array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND {SHINGLE - 1})),
n AS MATERIALIZED (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, least) USING KEY (node) AS (
  SELECT doc_id, doc_id FROM d WHERE doc_id IS NOT NULL
  UNION
  SELECT o.node, q.least FROM (SELECT e.a AS node, MIN(r.least) AS least FROM r JOIN e ON r.node = e.b GROUP BY e.a) q JOIN recurring.r o ON o.node = q.node WHERE q.least < o.least)
SELECT d.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, r.least AS component_id, d.doc_id = r.least AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON d.doc_id = r.node
"""
