"""Document fingerprints as invertible Bloom lookup sketches (operator 10), DataFrame functions only.

A text is cut into pieces, always by what stands there, not by what came before:
at line ends and at every sentence end of any script, and a piece
of over ``LONGEST`` characters after the tokens (short ASCII words, else single
characters) that a hash of them and the three before them picks, or after ``LONGEST`` characters if none does
(``cut_sentences``).  White space at a cut belongs to no piece.

Each piece has a 64-bit digest (42 bits of hash, told apart by its occurrence when
it repeats, and 22 bits that check them), which is added to one cell of each of
three tables.  A cell is the xor of its digests, so sketches subtract by xor: what
both texts hold cancels out.  The cells are the fingerprint.

Two texts are compared by subtracting cells and peeling: a cell that holds a
single digest passes its check and gives it away, and it is taken out of its other
cells, until nothing is left.  The least digests of both texts tell about how many
differ.  Where a fingerprint cannot hold that many, or does not peel, both are
sketched with ``CELLS_EACH`` cells for each differing digest, a cell being a stripe of
the digest space.  A stripe whose cell holds several differing ones is cut into ``FINER``
stripes; the digests of those that still do are sketched again in three tables, then in
larger ones (``WIDER``), which are peeled.  If a
stripe is left, all is done once more in ``FINER`` times as many stripes.  No other comparison
is behind it: if that failed too, nothing would count as shared.  The likeness is
shared over distinct pieces (1 for two texts without any).

Everything is an expression over one row; a stripe's work is bounded.

Edge cases: null text is empty; its sketch has empty cells; equal texts have
equal fingerprints; repeated ids follow one another in order of their text; an
empty table gives no rows; extra columns are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents
from .neighbours import with_next
from .registry import register
from .secrets import let

TABLES = 3
BASE_WIDTH = 8  # cells of each table of a fingerprint
BASE_HOLDS = 16  # differing digests a fingerprint is tried for
LEAST = 64  # digests that estimate a difference
CELLS_EACH = 2  # stripes (cells of the first table) for a differing digest
WIDER = (3, 7, *[21] * 5)  # cells of each table of a stripe, by retry; a digest's cells are bits of one long
FINER = 8
ROUNDS = 8
CHECK_BITS = 22
# Full stops before white space, or those of scripts that write none.
STOP = r"([.!?\u2026\u061f\u06d4\u0964\u0965\u1362\u104b])[\s\u00a0\u3000]+|([\u3002\uff01\uff1f\uff61])"
LINE_END = r"[\n\r\u0085\u2028\u2029]+"
LONGEST = 128  # characters of a piece
EVERY = 32  # characters between the cuts of a longer piece, about
TOKEN = r"(?<![A-Za-z0-9])[A-Za-z0-9]{1,24}(?![A-Za-z0-9])|(?s:.)"
_LOW = (1 << CHECK_BITS) - 1
_BITS = [1 << i for i in range(TABLES * max(WIDER))]


def cut_sentences(text: Column) -> Column:
    """Sentences of any script, the long ones in pieces of ``LONGEST`` characters at most."""
    def shorter(piece: Column) -> Column:
        def cut(tokens: Column) -> Column:
            def ends(t: Column, i: Column) -> Column:
                before = [F.get(tokens, i - k) for k in (1, 2, 3)]
                chosen = F.pmod(F.xxhash64(t, *before), F.lit(EVERY)) < F.char_length(t)
                return chosen & ~t.eqNullSafe(before[0])
            marked = F.transform(tokens, lambda t, i: F.when(ends(t, i), F.concat(t, F.lit("\n"))).otherwise(t))
            return F.regexp_extract_all(F.array_join(marked, ""), F.lit(f"[^\n]{{1,{LONGEST}}}"), F.lit(0))
        return let(F.regexp_extract_all(piece, F.lit(TOKEN), F.lit(0)), cut)
    pieces = F.filter(F.split(F.regexp_replace(text, STOP, "$1$2\n"), LINE_END, -1), lambda p: p != "")
    return F.flatten(F.transform(
        pieces, lambda p: F.when(F.char_length(p) > LONGEST, shorter(p)).otherwise(F.array(p))))


def _check(k: Column) -> Column:
    """The low bits that a digest with these high bits carries."""
    return F.xxhash64(k.bitwiseAND(F.lit(~_LOW))).bitwiseAND(F.lit(_LOW))


def _pure(cell: Column) -> Column:
    """True for a cell that holds a single digest (or, once in four million, several that look like one)."""
    return cell.bitwiseAND(F.lit(_LOW)) == _check(cell)


def paragraph_digests(text: Column, cut: Callable[[Column], Column] = cut_sentences) -> Column:
    """A sorted array of 64-bit digests, one for each occurrence of a piece."""
    def number(hashes: Column) -> Column:
        def occurrence(h: Column, i: Column) -> Column:
            again = F.get(hashes, i - 1).eqNullSafe(h)
            return F.when(again, (i + 1).cast("bigint") - F.array_position(hashes, h)).otherwise(F.lit(0).cast("bigint"))
        return F.transform(hashes, lambda h, i: F.xxhash64(h, occurrence(h, i)))
    numbered = let(F.sort_array(F.transform(cut(text), lambda p: F.xxhash64(p))), number)
    return F.sort_array(F.transform(numbered, lambda h: h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(_check(h))))


def _marked(digests: Column, width: Column, salt: Column) -> Column:
    """Digests with their cells, one in each table, as bits of a long."""
    def bits(h: Column) -> Column:
        one = F.lit(1).cast("bigint")
        marks = [F.call_function("shiftleft", one, (F.pmod(F.shiftrightunsigned(h, 20 * j), width) + width * j).cast("int"))
                 for j in range(TABLES)]
        return marks[0].bitwiseOR(marks[1]).bitwiseOR(marks[2])
    return F.transform(digests, lambda k: F.struct(k.alias("k"), let(F.xxhash64(k, salt), bits).alias("m")))


def _toggled(cell: Column, bit: Column, marked: Column) -> Column:
    """A cell after adding (or taking out, which is the same) the digests that fall into it."""
    return F.aggregate(marked, cell, lambda acc, x: F.when(
        x["m"].bitwiseAND(bit) > 0, acc.bitwiseXOR(x["k"])).otherwise(acc))


def cells(digests: Column, width: Column, salt: Column) -> Column:
    """The sketch of an array of digests: TABLES x width cells."""
    bits = F.slice(F.array(*[F.lit(b).cast("bigint") for b in _BITS]), F.lit(1), (width * TABLES).cast("int"))
    return let(_marked(digests, width, salt), lambda items: F.transform(
        bits, lambda bit: _toggled(F.lit(0).cast("bigint"), bit, items)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def peel(difference: Column, width: Column, salt: Column) -> Column:
    """Digests found by peeling a subtracted sketch; null where something is left."""
    def round_(acc: Column, _: Column) -> Column:
        def take(found: Column) -> Column:
            def clear(marked: Column) -> Column:
                return F.transform(acc["cells"], lambda c, i: _toggled(
                    c, F.call_function("shiftleft", F.lit(1).cast("bigint"), i), marked))
            rest = F.when(F.size(found) == 0, acc["cells"]).otherwise(let(_marked(found, width, salt), clear))
            return F.struct(rest.alias("cells"), F.concat(acc["found"], found).alias("found"),
                            (F.size(found) == 0).alias("done"))
        pure = F.filter(acc["cells"], lambda c: (c != 0) & _pure(c))
        return F.when(acc["done"], acc).otherwise(let(F.array_distinct(pure), take))

    start = F.struct(difference.alias("cells"), F.array().cast("array<bigint>").alias("found"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_,
                       lambda acc: F.when(F.forall(acc["cells"], lambda c: c == 0), acc["found"]))


def _stripe_difference(both: Column) -> Column:
    """Number of differing digests of a stripe, larger sketches until one peels; null if none does.

    ``both`` holds the digests of both texts: cells add up, so their sketch is
    the one text's minus the other's.
    """
    def attempt(done: Column, t: Column) -> Column:
        width, salt = t["w"], t["salt"]
        return F.coalesce(done, F.array_size(peel(cells(both, width, salt), width, salt)))
    tries = F.array(*[F.struct(F.lit(w).cast("bigint").alias("w"), F.lit(i + 1).alias("salt")) for i, w in enumerate(WIDER)])
    return F.aggregate(tries, F.lit(None).cast("int"), lambda d, t: F.when(d.isNotNull(), d).otherwise(attempt(d, t)))


def _striped_difference(a: Column, b: Column, expected: Column) -> Column:
    """Number of differing digests, from cells that each hold a stripe of the digest space (contiguous in sorted digests)."""
    def in_stripes(both: Column, n: Column, stuck: Callable[[Column], Column]) -> Column:
        def found(acc: Column) -> Column:
            held = F.slice(both, acc["first"] + 1, acc["i"] - acc["first"])
            return F.when(acc["cell"] == 0, 0).when(_pure(acc["cell"]), 1).otherwise(stuck(held))

        def state(s: Column, first: Column, i: Column, cell: Column, d: Column) -> Column:
            return F.struct(s.alias("s"), first.alias("first"), i.alias("i"), cell.alias("cell"), d.alias("d"))

        def step(acc: Column, k: Column) -> Column:
            s = F.coalesce(F.shiftright(F.shiftrightunsigned(k, 33) * n, 31), F.lit(-1).cast("bigint"))
            after = acc["i"] + 1
            return let(s, lambda s: F.when(
                acc["s"] == s, state(s, acc["first"], after, acc["cell"].bitwiseXOR(k), acc["d"])).otherwise(
                state(s, acc["i"], after, k, acc["d"] + found(acc))))

        end = F.array(F.lit(None).cast("bigint"))  # closes the last stripe
        none = F.lit(0).cast("bigint")
        start = state(F.lit(-2).cast("bigint"), F.lit(0), F.lit(0), none, F.lit(0))
        return F.aggregate(F.concat(both, end), start, step, lambda acc: acc["d"])

    def difference(both: Column, n: Column) -> Column:
        # peeling costs most: a stripe that holds several differing digests is cut finer first
        return in_stripes(both, n, lambda held: let(held, lambda h: in_stripes(h, n * FINER, _stripe_difference)))

    def total(both: Column) -> Column:
        n = F.greatest(F.lit(1).cast("bigint"), F.ceil(expected * CELLS_EACH))
        tries = F.array(n, n * FINER)
        return F.aggregate(tries, F.lit(None).cast("int"),
                           lambda d, t: F.when(d.isNotNull(), d).otherwise(difference(both, t)))
    return let(F.sort_array(F.concat(a, b)), total)


def expected_difference(a: Column, b: Column) -> Column:
    """Upper estimate of the number of differing digests, from the least ``LEAST`` of both."""
    both = F.size(a) + F.size(b)

    def estimate(shared: Column) -> Column:
        def grown(low: Column) -> Column:
            return both * (1 - low) / (1 + low)
        seen = F.least(both - shared, F.lit(LEAST))
        low = let(shared / seen, lambda x: F.greatest(F.lit(0.0), x - 2 * F.sqrt(x * (1 - x) / LEAST) - 1 / LEAST))
        return F.when(both <= LEAST, (both - 2 * shared).cast("double")).otherwise(let(low, grown))
    return let(F.size(F.array_intersect(F.slice(a, 1, LEAST), F.slice(b, 1, LEAST))), estimate)


def likeness(a: Column, b: Column, a_cells: Column, b_cells: Column) -> Column:
    """Shared over distinct digests (0 to 1), from the fingerprints' own cells first."""
    width, salt = F.lit(BASE_WIDTH).cast("bigint"), F.lit(0)
    both = F.size(a) + F.size(b)

    def compare(expected: Column) -> Column:
        own = F.when(expected <= BASE_HOLDS, F.array_size(peel(subtract(a_cells, b_cells), width, salt)))
        return let(own, lambda d: F.coalesce(
            d, F.when(a_cells == b_cells, F.lit(0)), _striped_difference(a, b, expected), both))
    share = let(let(expected_difference(a, b), compare), lambda d: (both - d) / (both + d))
    return F.when(both == 0, F.lit(1.0)).otherwise(share)


def serialised(digests: Column, cs: Column) -> Column:
    """Number of pieces, then the cells in hexadecimal, "-" for an empty one."""
    def one(c: Column) -> Column:
        return F.when(c == 0, F.lit("-")).otherwise(F.lower(F.hex(c)))
    return F.concat_ws(" ", F.size(digests).cast("string"), F.transform(cs, one))


def sketch(text: Column, cut: Callable[[Column], Column] = cut_sentences) -> Column:
    """(digests, cells) of a text."""
    width, salt = F.lit(BASE_WIDTH).cast("bigint"), F.lit(0)
    return let(paragraph_digests(text, cut), lambda d: F.struct(d.alias("d"), cells(d, width, salt).alias("c")))


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    cut: Callable[[Column], Column] = cut_sentences) -> DataFrame:
    """doc_id, text, sketch, the next document's sketch, and the text with its latter half taken from the next one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = with_next(rows, "doc_id", ["text"], ["text", "own"], derive=lambda r: r.withColumn("own", sketch(F.col("text"), cut)))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    return rows.select("doc_id", "text", "own", "next_own", n.cast("bigint").alias("n_chars"), edited.alias("edited"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 cut: Callable[[Column], Column] = cut_sentences) -> DataFrame:
    """Fingerprints of each text and of its edited version, and their likenesses."""
    rows = edited_versions(docs, id_col, text_col, cut)
    both = let(sketch(F.col("edited"), cut), lambda e: F.struct(
        serialised(e["d"], e["c"]).alias("print"),
        likeness(F.col("own")["d"], e["d"], F.col("own")["c"], e["c"]).alias("near")))
    rows = rows.withColumn("e", both)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        serialised(F.col("own")["d"], F.col("own")["c"]).alias("fingerprint"), F.col("e")["print"].alias("edited_fingerprint"),
        F.col("e")["near"].alias("near_edited"),
        likeness(F.col("own")["d"], F.col("next_own")["d"], F.col("own")["c"], F.col("next_own")["c"]).alias("near_next"))


@register("op10_lookup_sketches")
def op10(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir))
