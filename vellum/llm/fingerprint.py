"""Document fingerprints from closed syncmers, with Spark expressions only.

A k-mer of K code points is an anchor if the smallest of the hashes of its S-mers is that of its first or its last S-mer. That depends on the
k-mer alone, not on what surrounds it, so a text and its edited form share every anchor that lies in a shared passage. A fingerprint is the
sequence of anchors, each as 32 bits of a hash of the k-mer and of its distance from the anchor before (its position, so that matches have to
keep their place relative to each other while a passage may move as a whole). Likeness is the share of the anchors of both that are in both.

Positions are found in pieces of PIECE code points that overlap by K - 1, which gives the same anchors as the whole text and bounds the arrays.

Defined results: a null text is empty; an empty text has no anchors and is like another empty text only (1.0); another text without anchors has
one, the whole text: each text shorter than K, and some of up to 2 K - S - 2 code points, as one more always hold an anchor; repeated rows stay; an empty table gives an empty table; other columns are dropped. The next document is the next row by
doc_id (null first), then by a hash of the text.
"""

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import code_points, let, part

S, SPAN = 8, 16
K = S + SPAN - 1
PIECE = 4096
#: Rows that a bucket has on average, the most buckets that there are (beyond, they grow), and the quantiles of doc_id that the driver holds.
ROWS, BUCKETS, QUANTILES = 1024, 1 << 16, 1024


def _anchors_of_piece(piece: Column, offset: Column) -> Column:
    n = (F.octet_length(piece) / 4).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(part(piece, i, S)))

    def found(h: Column) -> Column:
        def halves(least: Column, width: int) -> Column:
            if width == SPAN:
                at_edge = lambda i: (F.get(least, i) == F.get(h, i)) | (F.get(least, i) == F.get(h, i + SPAN - 1))
                return F.transform(F.filter(F.sequence(F.lit(0), n - K), at_edge), lambda i: offset + i)
            twice = F.zip_with(least, F.slice(least, width + 1, F.size(least)), lambda a, b: F.least(a, b))
            return let(twice, lambda x: halves(x, 2 * width))

        return halves(h, 1)

    return let(hashes, found)


def anchors(points: Column) -> Column:
    """Positions of the anchors in code points, ascending; none if there are fewer than K."""
    n = (F.octet_length(points) / 4).cast("int")
    starts = F.sequence(F.lit(0), n - K, F.lit(PIECE))
    pieces = F.transform(starts, lambda o: let(part(points, o, PIECE + K - 1), lambda p: _anchors_of_piece(p, o)))
    return F.when(n >= K, F.flatten(pieces)).otherwise(F.array().cast("array<int>"))


def high(c: Column) -> Column:
    return F.shiftrightunsigned(c, 32)


def tokens(points: Column, positions: Column, before: Column) -> Column:
    """The anchors' hashes. before: position of the anchor before the first, null if there is none."""

    def token(p: Column, i: Column) -> Column:
        gap = p - F.coalesce(F.get(positions, i - 1), before, p)
        return high(F.xxhash64(F.concat(part(points, p, K), gap.cast("string").cast("binary"))))

    return F.transform(positions, token)


def whole(points: Column) -> Column:
    """What stands for a text without anchors."""
    return F.when(F.octet_length(points) > 0, F.array(high(F.xxhash64(points)))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(text: Column) -> Column:
    """struct(pos, tok) of a text."""

    def of(points: Column) -> Column:
        none = F.lit(None).cast("int")
        return let(anchors(points), lambda pos: F.struct(pos.alias("pos"), F.when(F.size(pos) == 0, whole(points)).otherwise(tokens(points, pos, none)).alias("tok")))

    return let(code_points(text), of)


def edited_tokens(pos: Column, tok: Column, n: Column, cut: Column, kept: Column, new: Column, every: Column) -> Column:
    """Hashes of the text whose code points from cut on are replaced by new: those before cut as they are, the rest anew.

    kept: the last K - 1 code points before cut (or all of them); anchors inside it alone do not exist, so none counts twice.
    every: the edited text, read only where it has no anchors.
    """
    start = (cut - F.length(kept)).cast("int")

    def of(points: Column) -> Column:
        stay = F.size(F.filter(pos, lambda p: p + K <= cut))

        def rest(k: Column) -> Column:
            before = F.get(pos, k - 1) - start
            return let(anchors(points), lambda own: F.concat(F.slice(tok, F.lit(1), k), tokens(points, own, before)))

        return let(let(stay, rest), lambda found: F.when(F.size(found) == 0, whole(code_points(every))).otherwise(found))

    return let(code_points(F.concat(kept, new)), of)


def shown(tok: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits an anchor."""
    return F.lower(F.array_join(F.transform(tok, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors over all anchors of both, 0 to 1."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(F.lit(1.0))


class Buckets:
    """Ranges of (doc_id, tie) that hold about rows rows each, in order: null ids first, which are cut by tie, then each stretch between two edges.

    Edges are approximate quantiles of doc_id, and a stretch is cut evenly. An id that several quantiles fall on is repeated so often that its own rows
    are cut by tie.
    """

    def __init__(self, docs: DataFrame, rows: int = ROWS):
        every = [i / QUANTILES for i in range(QUANTILES + 1)]
        n, nulls, q = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", every, 10 * QUANTILES)).first()
        per = max(1, rows, -(-n // BUCKETS))
        parts = lambda share: max(1, round(share / per))
        self.nulls, real = (parts(nulls) if nulls else 0), n - nulls
        bins = max(1, min(QUANTILES, real // per))
        often = {x: bisect_right(q, x) - bisect_left(q, x) - 1 for x in set(q or [])}
        self.edges = sorted({q[round(i * QUANTILES / bins)] for i in range(bins + 1)} | {x for x, k in often.items() if k > 1}) if q else []
        self.own = [parts(often[x] * real / QUANTILES) if often[x] > 1 else 0 for x in self.edges]
        self.cuts = [max(1, parts((bisect_left(q, y) - bisect_right(q, x) + 1) * real / QUANTILES)) for x, y in zip(self.edges, self.edges[1:])] + [1] if q else []
        self.base = [self.nulls]
        for a, b in zip(self.own, self.cuts, strict=True):
            self.base.append(self.base[-1] + a + b)
        self.number = max(1, self.base[-1])

    def of(self, doc_id: Column, tie: Column) -> Column:
        """The number of the bucket, an int from 0; rows with one doc_id and tie share it."""

        def by_tie(n: Column) -> Column:
            return F.least(n - 1, F.floor((tie.cast("double") / F.lit(2.0**64) + 0.5) * n)).cast("int")

        if not self.edges:
            return by_tie(F.lit(self.number))
        kinds = {"edges": "bigint", "own": "int", "cuts": "int", "base": "int"}
        a = {k: F.array(*[F.lit(x) for x in getattr(self, k)]).cast(f"array<{t}>") for k, t in kinds.items()}

        def at(i: Column) -> Column:
            low, up, own, cuts = F.get(a["edges"], i), F.coalesce(F.get(a["edges"], i + 1), F.get(a["edges"], i)), F.get(a["own"], i), F.get(a["cuts"], i)
            share = (doc_id.cast("double") - low) / F.greatest(up.cast("double") - low, F.lit(1.0))
            inside = own + F.least(cuts - 1, F.greatest(F.lit(0), F.floor(share * cuts).cast("int")))
            return F.get(a["base"], i) + F.when((own > 0) & (doc_id == low), by_tie(own)).otherwise(inside)

        i = F.greatest(F.size(F.filter(a["edges"], lambda x: x <= doc_id)) - 1, F.lit(0))
        return F.when(doc_id.isNull(), by_tie(F.lit(max(1, self.nulls)))).otherwise(let(i, at)).cast("int")


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, text, f (struct pos, tok), next_text, next_tok of each row; the row after the last is the first.

    One shuffle of the texts, to a task for each bucket; the hashes are computed behind it. The row after a bucket's last is the first of the next
    bucket that has rows: its key is known from a scan that shuffles a row per bucket and task, and a copy of it is dealt to the bucket before.
    The table of these keys has at most BUCKETS rows and so is broadcast.
    """
    b = Buckets(docs, rows)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    base = base.withColumn("bucket", b.of(F.col("doc_id"), F.col("tie")))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")
    firsts = base.groupBy("bucket").agg(F.min(key).alias("first"))
    in_order = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(in_order), F.max("bucket").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = firsts.select("bucket", "first", before.alias("before"))
    copied = base.join(F.broadcast(heads), "bucket").filter(key == F.col("first")).groupBy(F.col("before").alias("bucket")).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tie").alias("tie"))
    both = base.select("bucket", "doc_id", "text", "tie", F.lit(False).alias("copy")).unionByName(copied.withColumn("copy", F.lit(True)))
    order = [F.col("copy").asc(), F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    dealt = both.repartitionById(b.number, F.col("bucket")).sortWithinPartitions("bucket", *order)
    f = dealt.withColumn("f", fingerprint(F.col("text")))
    out = f.withColumn("next", F.lead(F.struct("text", F.col("f.tok").alias("tok"))).over(Window.partitionBy("bucket").orderBy(*order)))
    return out.filter(~F.col("copy")).select("doc_id", "text", "f", F.col("next.text").alias("next_text"), F.col("next.tok").alias("next_tok"))


def report(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and the next document's are."""
    d = with_next(docs.select("doc_id", "text"), rows)
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    cut = n - q
    d = d.withColumns({"n": n, "cut": cut, "new": F.substring("next_text", F.lit(1), q)})
    kept = F.least(F.col("cut"), F.lit(K - 1))
    edited = F.concat(F.substring("text", F.lit(1), F.col("cut")), "new")
    d = d.withColumns(
        {
            "e": edited_tokens(F.col("f.pos"), F.col("f.tok"), F.col("n"), F.col("cut"), F.substring("text", F.col("cut") - kept + 1, kept), F.col("new"), edited),
            "edited_sha256": F.sha2(edited, 256),
        }
    )
    return d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        shown(F.col("f.tok")).alias("fingerprint"),
        shown(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f.tok"), F.col("e")).alias("near_edited"),
        likeness(F.col("f.tok"), F.col("next_tok")).alias("near_next"),
    )
