"""Benchmark decontamination by spaced-seed hashing (operator 10), in DataFrame functions only.

Texts become lower-case runs of letters and digits. A fixed mask looks at some
positions of a short window and ignores the others, so a window that differs
only at ignored positions still hashes alike. The test items' hashes are joined
with the documents'; around each hit the aligned stretch of the item, some
twenty tokens about the window as far as the item goes, is compared token by
token. It is an overlap where at least ``RATIO`` percent of it agree, or where
``RUN`` tokens in a row from the window on do.

``MASKS`` are the ways to look at four of five tokens, and one that bridges two
neighbours: together they hit at least 99 of 100 random patterns of
substitutions that the ratio allows, for items of any length (tests count all
patterns of the short items). Items of up to four tokens are sought by masks of
their own length under the same ratio: three of four, or all of three or fewer.

Before the join, windows are looked up in a bitmap of the items' hashes held in
the plan; it lets all true hits and few other windows pass, and its size is
bounded. The items' hashes are broadcast if they and their stretches are below
``BROADCAST_ROWS`` rows (of at most 250 bytes) and joined by a shuffle
otherwise; both give the same rows. Documents' texts are never shuffled: a hit
carries its few tokens along.

Defined cases: null and empty texts match nothing; a text of any length is
searched whole; an item of one token is found wherever that token stands; ties
of the best match go to the shorter stretch; repeated rows of either side are
joined each; null ids are kept as ids; empty tables match nothing. Only the
named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Looked-at positions of each mask.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 5, 6, 7))
#: Masks of items with so many tokens, which no mask above looks at with a substitution to spare.
SHORT = {1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: ((0, 1, 3), (0, 2, 3), (1, 2, 3), (0, 1, 2))}
#: Tokens of the stretch before a window's start and from it on.
BEFORE, AFTER = 7, 13
RATIO = 75
RUN = 10
BROADCAST_ROWS = 200_000
#: The bitmap has 64 bits a hash, up to so many words of 64 bits.
MOST_WORDS = 1 << 18


def tokens(text: Column) -> Column:
    """64-bit hashes of a text's tokens, in order."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))


def masks_of(lengths: list[int]) -> list[tuple[int, ...]]:
    """The masks that items of these lengths need."""
    general = list(MASKS) if max(lengths, default=0) > 4 else []
    return general + list(dict.fromkeys(m for n in sorted(SHORT) if n in lengths for m in SHORT[n]))


def _hash(at: Column, positions: tuple[int, ...]) -> Column:
    """Hash of the looked-at tokens of ``w`` from ``at`` on, with the mask itself; tokens beyond the end are left out."""
    return F.xxhash64(F.lit(sum(1 << p for p in positions)), *[F.get("w", at + p if p else at) for p in positions])


def item_seeds(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(item_id, a, seed, left, stretch) of each window of each item, and the masks in use."""
    words = items.select(F.col(item_id).alias("item_id"), tokens(F.col(text)).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    small = sorted(r["n"] for r in words.select(F.least("n", F.lit(5)).alias("n")).distinct().collect())  # five numbers at most
    masks = masks_of(small)
    places = words.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    found = []
    for m in masks:
        served = F.col("n") > 4 if m in MASKS else F.col("n").isin([n for n, own in SHORT.items() if m in own])
        found.append(F.when(served & (F.col("a") + (m[-1] + 1) <= F.col("n")), _hash(F.col("a"), m)))
    left = F.least(F.col("a"), F.lit(BEFORE))
    length = F.least(F.col("n"), F.col("a") + AFTER) - (F.col("a") - left)
    narrow = places.select("item_id", "a", left.alias("left"), F.slice("w", F.col("a") - left + 1, length).alias("stretch"), F.array(*found).cast("array<long>").alias("seeds"))
    return narrow.select("item_id", "a", F.explode("seeds").alias("seed"), "left", "stretch").where("seed is not null"), masks


def _bitmap(seeds: DataFrame, n_seeds: int) -> tuple[Column, int]:
    """The seeds as an array of 64-bit words in the plan, and its length."""
    size = 64
    while size < n_seeds and size < MOST_WORDS:
        size *= 2
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(seed, 58) as int))")
    rows = seeds.groupBy((F.col("seed").bitwiseAND(F.lit(size - 1))).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    bits = [0] * size
    for r in rows:
        bits[r["word"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>"), size


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_hits, best_match, best_span): each document and item with a verified overlap."""
    seeds, masks = item_seeds(items, item_id, item_text)
    n_seeds = seeds.count()  # of the test items alone
    bitmap, size = _bitmap(seeds, n_seeds)
    # A row for each place of a text, then one for each mask: plain expressions on the array, compiled into one stage with
    # the lookup in the bitmap (each hash stands in it once; a larger stage is too long to be compiled well). What leaves
    # that stage is narrow: a place must not carry its whole text along.
    words = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    places = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    places = places.select("doc_id", "w", "i", F.explode(F.array(*[_hash(F.col("i"), m) for m in masks]).cast("array<long>")).alias("h"))
    h = F.col("h")
    places = places.where(F.getbit(F.get(bitmap, h.bitwiseAND(F.lit(size - 1)).cast("int")), F.shiftrightunsigned(h, 58).cast("int")) == 1)
    before = F.least(F.col("i"), F.lit(BEFORE))
    hit = places.select("doc_id", "i", before.alias("before"), F.slice("w", F.col("i") - before + 1, F.lit(BEFORE + AFTER)).alias("around"), "h")
    side = F.broadcast(seeds) if n_seeds <= BROADCAST_ROWS else seeds
    both = hit.join(side, F.col("h") == F.col("seed"))
    same = lambda j: F.get("around", j - F.col("left") + F.col("before")) == F.get("stretch", j)
    agree = F.size(F.filter(F.sequence(F.lit(0), F.size("stretch") - 1), same))
    run = (F.size("stretch") - F.col("left") >= RUN) & (F.size(F.filter(F.sequence(F.lit(0), F.lit(RUN - 1)), lambda j: same(F.col("left") + j))) == RUN)
    both = both.select("doc_id", "item_id", "i", "a", agree.alias("agree"), F.size("stretch").alias("span"), run.alias("run")).where(f"run or 100 * agree >= {RATIO} * span")
    best = F.max(F.struct("agree", F.negative("span").alias("s")))
    return both.groupBy("doc_id", "item_id").agg(F.countDistinct("i", "a").alias("n_hits"), best.alias("best")).select("doc_id", "item_id", "n_hits", F.col("best.agree").alias("best_match"), F.negative(F.col("best.s")).alias("best_span"))


def oracle() -> str:
    """The same documents and items by plain SQL and without masks: all alignments, each counted at every window of five tokens (or the whole shorter item)."""
    words = lambda t, key: f"{t}_w AS (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {t})"
    place = lambda t, key: f"{t}_t AS (SELECT {key}, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS t FROM {t}_w)"
    return f"""WITH {words('documents', 'doc_id')}, {words('benchmark', 'item_id')}, {place('documents', 'doc_id')}, {place('benchmark', 'item_id')},
lines AS (SELECT doc_id, item_id, any_value(b.n) AS n, list(b.i) AS js FROM documents_t d JOIN benchmark_t b ON d.t = b.t GROUP BY doc_id, item_id, d.i - b.i HAVING count(*) >= least(8, ceil(any_value(b.n) * {RATIO} / 100.0))),
placed AS (SELECT doc_id, item_id, n, js, unnest(range(greatest(n - 3, 1))) AS a FROM lines),
seen AS (SELECT doc_id, item_id, len(list_filter(js, lambda j: j >= a - {BEFORE} AND j < a + {AFTER})) AS agree, least(n, a + {AFTER}) - greatest(a - {BEFORE}, 0) AS span, len(list_filter(js, lambda j: j >= a AND j < a + {RUN})) AS run FROM placed)
SELECT DISTINCT doc_id, item_id FROM seen WHERE run = {RUN} OR 100 * agree >= {RATIO} * span"""
