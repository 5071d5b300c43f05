"""Near copies for the pipeline: the fingerprints of operator 3, and shared shingles that three bits do not show.

Texts are first grouped by :func:`simhash.near_links`.  Texts of different groups that share a band of MinHash values
over their shingles of SHINGLE words are then held together and linked where the exact Jaccard similarity of their
shingle sets is at least SIMILARITY.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .decontam import shingles
from .simhash import _LOWER, fingerprint, near_links
from .store import BROADCAST_NARROW, Scratch, materialize, small_side

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at the similarity 0.8 shares no band with a chance of (1 - 0.8^5)^28 = 1.5e-5.
BANDS = 28
ROWS = 5
#: Least hashes that must agree (in one byte) before texts are fetched; a pair at 0.8 has fewer with a chance of 2e-8.
AGREE = 84
SEED = 42
#: Shingles hashed at once, which bounds the memory that a very long text takes.
CHUNK = 4096

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None) -> frozenset[bytes]:
    """The distinct shingles of a text (of one with fewer words: its whole sequence; none without words)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return frozenset(shingles(words, min(SHINGLE, len(words)))) if words else frozenset()


def alike(a: frozenset[bytes], b: frozenset[bytes]) -> bool:
    """Whether the Jaccard similarity of two sets is at least SIMILARITY; never for empty ones."""
    shared = len(a & b)
    return shared > 0 and shared >= SIMILARITY * (len(a) + len(b) - shared) - 1e-9


def band_keys(own: frozenset[bytes]) -> tuple[list[int], bytes]:
    """One signed 64-bit key for each band of ROWS least hashes, and a byte of each of these hashes."""
    if not own:
        return [], b""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), np.uint64, len(own))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[at : at + CHUNK, None] * _TIMES + _PLUS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist(), least.astype(np.uint8).tobytes()


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sketches(docs: DataFrame) -> DataFrame:
    """d (MD5 of the text; null as empty), fp, n (distinct shingles), keys, sig and copies of the distinct texts of ``docs``."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py()
                own = shingle_set(text)
                out.append((np.uint64(fingerprint(text)).view(np.int64).item(), len(own), *band_keys(own)))
            fp, n, keys, sig = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["d", "fp", "n", "keys", "sig"])

    # Texts are hashed where they are read: only sketches are shuffled, and copies are counted on the map side.
    rows = docs.select(_digest("text").alias("d"), "text").mapInArrow(run, "d binary, fp long, n long, keys array<long>, sig binary")
    return rows.groupBy("d", "fp", "n", "keys", "sig").agg(F.count("*").alias("copies"))


def _bodies(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """d and text of the texts named in ``ids`` (d), each once."""
    rows = docs.select(_digest("text").alias("d"), "text").join(small_side(ids, BROADCAST_NARROW), "d", "left_semi")
    return rows.groupBy("d").agg(F.any_value("text").alias("text"))


def _verified(pairs: DataFrame, docs: DataFrame, held: Scratch) -> DataFrame:
    """ra, rb of the ``pairs`` (a, b, ra, rb) whose texts are alike."""
    ids = held.keep(pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct(), "ids")
    bodies = held.keep(_bodies(docs, ids), "bodies")

    def run(batches):
        known = lru_cache(maxsize=16)(shingle_set)  # centres come in runs
        for batch in batches:
            ok = [alike(known(x.as_py()), shingle_set(y.as_py())) for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("ra", "rb")], names=["ra", "rb"])

    one, two = (bodies.select(F.col("d").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return pairs.join(two, "b").join(one, "a").select("ta", "tb", "ra", "rb").mapInArrow(run, "ra long, rb long")


def _promising(met: DataFrame) -> DataFrame:
    """a, b, ra, rb of the pairs ``met`` of which AGREE bytes of sa and sb agree, each once."""

    def run(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
            near = pa.array((one == two).sum(axis=1) >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b", "ra", "rb")], names=["a", "b", "ra", "rb"])

    return met.select("a", "b", "ra", "rb", "sa", "sb").mapInArrow(run, "a binary, b binary, ra long, rb long").distinct()


def _sizes_allow(one: str, two: str) -> Column:
    return F.least(one, two) >= SIMILARITY * F.greatest(one, two) - 1e-9


def _rooted(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """``texts`` with the root of the group that its own root (at first fp) belongs to."""
    named = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return texts.join(named, F.col("root") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "root")).drop("_node", "_root")


def _shared(spread: DataFrame, held: Scratch) -> DataFrame:
    """key and d of the rows of ``spread`` whose keys texts of different groups share; of texts nothing else is dealt by key."""
    roots = spread.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    shared = held.keep(roots.where("lo < hi").select("key"), "shared")
    return held.keep(spread.select("key", "d").join(small_side(shared, BROADCAST_NARROW), "key", "left_semi"), "spread")


def _mixed(texts: DataFrame, spread: DataFrame, *more: str) -> DataFrame:
    """key, d, n, root, sig and the columns ``more`` of the texts under the keys of ``spread`` (:func:`_shared`)."""
    return spread.join(texts.select("d", "n", "root", "sig", *more), "d")


def _centred(mixed: DataFrame) -> DataFrame:
    """Pairs of each text with the centre of each of its keys: the text with most copies, of which the others were made."""
    centre = mixed.groupBy("key").agg(F.max(F.struct("copies", "d", "n", "root", "sig")).alias("c"))
    met = mixed.select("key", "d", "n", "root", F.col("sig").alias("sb")).join(centre, "key").select("d", "n", "root", "sb", F.col("c.sig").alias("sa"), F.col("c.d").alias("a"), F.col("c.n").alias("na"), F.col("c.root").alias("ra"))
    met = met.where((F.col("root") != F.col("ra")) & _sizes_allow("n", "na"))
    return _promising(met.select("a", F.col("d").alias("b"), "ra", F.col("root").alias("rb"), "sa", "sb"))


def _across(mixed: DataFrame) -> DataFrame:
    """Pairs of texts of different groups that share a key, each once: one of the two is outside the largest group of the key."""
    sizes = mixed.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("root", "c").alias("main"))
    odd = mixed.join(main, "key").where("root <> main")
    one, two = (t.select("key", *[F.col(c).alias(f"{c}{x}") for c in ("d", "n", "root", "keys")], F.col("sig").alias(f"s{x}")) for t, x in ((odd, "a"), (mixed, "b")))
    first = F.col("key") == F.array_min(F.array_intersect("keysa", "keysb"))
    met = one.join(two, "key").where((F.col("roota") != F.col("rootb")) & _sizes_allow("na", "nb") & first)
    swap = F.col("da") > F.col("db")
    pick = lambda c: (F.when(swap, F.col(f"{c}b")).otherwise(F.col(f"{c}a")), F.when(swap, F.col(f"{c}a")).otherwise(F.col(f"{c}b")))
    (a, b), (ra, rb) = pick("d"), pick("root")
    return _promising(met.select(a.alias("a"), b.alias("b"), ra.alias("ra"), rb.alias("rb"), "sa", "sb"))


def text_groups(docs: DataFrame) -> DataFrame:
    """d (MD5 of the text) and root (equal for near copies) of the distinct texts of ``docs`` (text)."""
    with Scratch(docs.sparkSession, "near-copies") as held:
        found = held.keep(sketches(docs), "sketches")
        prints = held.keep(found.select("fp").distinct(), "prints")
        texts = found.withColumn("root", F.col("fp"))
        texts = held.keep(_rooted(texts, connected_components(near_links(prints), "a", "b")), "by-fingerprint")
        spread = texts.select(F.explode("keys").alias("key"), "d", "root")
        for pairs_of, name, more in ((_centred, "centres", "copies"), (_across, "across", "keys")):
            dealt = _shared(spread, held)
            mixed = held.keep(_mixed(texts, dealt, more), f"mixed-{name}")
            pairs = held.keep(pairs_of(mixed), f"pairs-{name}")
            links = held.keep(_verified(pairs, docs, held), f"links-{name}")
            texts = held.keep(_rooted(texts, connected_components(links, "ra", "rb")), f"by-{name}")
            spread = dealt.join(texts.select("d", "root"), "d")  # groups only grow together: no other key can be mixed
        return materialize(texts.select("d", "root"), "text-groups")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its group of near copies; all their columns.

    Texts are near copies if their fingerprints link (operator 3) or if the Jaccard similarity of their distinct
    shingles of SHINGLE words is at least SIMILARITY; groups are closed under such links.  Texts with fewer words are
    one shingle; null texts and texts without words are one group.  Rows that repeat a doc_id go only where none of
    their texts leads a group; rows with a null doc_id stay and lead none; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = text_groups(own.select("text"))
    placed = own.select("doc_id", _digest("text").alias("d")).where("doc_id is not null").join(groups, "d")
    placed = materialize(placed.select("doc_id", "root"), "near-placed")
    leads = placed.groupBy("root").agg(F.min("doc_id").alias("lead"))
    marked = placed.join(leads, "root").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("lead")).alias("leads"))
    gone = materialize(marked.where("not leads").select(F.col("doc_id").alias("_gone")), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"))
    return rows.join(gone.hint("merge"), F.col("_id") == F.col("_gone"), "left_anti").select("row.*")
