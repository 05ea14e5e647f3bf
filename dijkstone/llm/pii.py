r"""Personal data in texts, in DataFrame functions only: patterns propose, checksums confirm, nearby words adjust the score.

A kind has a pattern, a test of what it matches, and words that are likely beside it. A text is split at the matches of a
pattern, so that the places of all follow from the lengths of the parts, as running sums. A match that passes its test
begins with the kind's score; a confirmed checksum and a context word in the ``BEFORE`` code points before it or the
``AFTER`` after it add to that. Kinds in ``BASE`` are reported whatever their score, others from ``LEAST_SCORE`` on, and
those without a checksum only where they don't overlap one of ``BASE``.

Patterns are written so that no place is tried twice: runs are taken whole (possessive), and begin only where no longer run
could (or where the last match ended), which leaves the leftmost matches as they are. So time is linear in a text's length.
What may come before is tested after the first sign, as few places have one.

Defined results: a null or empty text has no spans. Places are code points, the end exclusive. Spans of different kinds may
overlap; those of one kind can't. Rows with null or equal ids are judged each by itself. Extra columns pass through; one that
has the name of the result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SCORE = 0.5
CHECKSUM, CONTEXT = 0.3, 0.3
BEFORE, AFTER = 40, 20
#: Sums run within blocks of so many parts, and then over blocks.
_BLOCK = 128


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Whether a match stands; of the match.
    stands: object
    score: float
    context: tuple[str, ...]
    #: Whether ``stands`` holds a checksum, which adds to the score.
    checked: bool = False
    base: bool = False
    #: A sign that every match has; texts without it aren't searched.
    sign: str = ""


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _phone(hit: Column) -> Column:
    return _between(F.length(digits(hit)), 9, 15)


def _card(hit: Column) -> Column:
    return _between(F.length(digits(hit)), 12, 19) & F.call_function("luhn_check", digits(hit))


def mod97(hit: Column) -> Column:
    """Whether the first four characters after the others, with letters as 10 to 35, leave 1 of 97."""
    code = F.regexp_replace(hit, " ", "")
    order = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    signs = F.filter(F.split(order, ""), lambda c: c != "")
    values = F.transform(signs, lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    rest = F.aggregate(values, F.lit(0), lambda acc, v: (acc * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return _between(F.length(code), 15, 34) & (rest == 1)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda h: F.lit(True), 0.6, ("email", "e-mail", "mail", "contact"), base=True, sign="@"),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", lambda h: F.rlike(h, F.lit(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")), 0.4, ("ip", "host", "server", "address"), base=True),
    Kind(
        "card", r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])", _card, 0.3, ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"), checked=True, base=True
    ),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _phone, 0.5, ("phone", "tel", "call", "mobile", "telefon", "fax"), base=True, sign="+"),
    Kind("iban", r"[A-Z](?<![A-Za-z0-9_][A-Z])[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])", mod97, 0.4, ("iban", "account", "bank", "konto", "compte", "cuenta"), checked=True),
    Kind(
        "ssn", r"[0-9](?<![A-Za-z0-9_][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", lambda h: ~F.rlike(h, F.lit("^(?:000|666|9)|-00-|-0000$")), 0.3, ("ssn", "social", "security")
    ),
    Kind("local_phone", r"0(?<![A-Za-z0-9_]0)[0-9]{1,3}[ -][0-9]{3,4}[ -]?[0-9]{3,4}(?![A-Za-z0-9_])", lambda h: F.lit(True), 0.2, ("phone", "tel", "call", "mobile", "telefon", "fax")),
)
SPAN = "start:bigint,rank:int,end:bigint,kind:string,text:string,score:double,evidence:string"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though lambdas within ask for it often."""
    return F.transform(F.array(value), use)[0]


def running_sums(values: Column) -> Column:
    """The sums of an array's values from its first to each one; linear but for blocks."""

    def of(v: Column) -> Column:
        none = F.array().cast("array<bigint>")
        block = lambda i: F.aggregate(F.slice(v, i * _BLOCK + 1, F.lit(_BLOCK)), none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / _BLOCK).cast("int") - 1), block)
        zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<array<bigint>>").alias("out"))
        step = lambda acc, b: F.struct((acc["sum"] + F.element_at(b, -1)).alias("sum"), F.concat(acc["out"], F.array(F.transform(b, lambda x: x + acc["sum"]))).alias("out"))
        return F.flatten(F.aggregate(blocks, zero, step)["out"])

    return F.when(F.size(values) > 0, _bound(values, of)).otherwise(F.array().cast("array<bigint>"))


def _evidence(kind: Kind, around: Column) -> Column:
    """The first context word in what surrounds a match; none: empty."""
    return F.regexp_extract(F.lower(around), "(?:^|[^a-z])(" + "|".join(kind.context) + ")(?:[^a-z]|$)", 1)


def _spans(kind: Kind, rank: int, parts: Column, sums: Column) -> Column:
    """Spans from the parts (gap, hit) of a text, the last without a hit, and the running sums of their lengths."""

    def span(x: Column) -> Column:
        hit = x["p"]["hit"]
        around = F.concat(F.right(x["p"]["gap"], F.lit(BEFORE)), F.lit(" "), F.left(x["next"], F.lit(AFTER)))
        evidence = _evidence(kind, around)
        score = F.lit(kind.score + (CHECKSUM if kind.checked else 0.0)) + F.when(evidence != "", CONTEXT).otherwise(0.0)
        return F.struct(
            (x["sum"] - F.length(hit)).alias("start"), F.lit(rank).alias("rank"), x["sum"].alias("end"), F.lit(kind.name).alias("kind"), hit.alias("text"), F.least(F.lit(1.0), score).alias("score"), evidence.alias("evidence")
        )

    following = F.slice(F.transform(parts, lambda p: p["gap"]), F.lit(2), F.size(parts))
    joined = F.arrays_zip(parts.alias("p"), sums.alias("sum"), following.alias("next"))
    told = F.transform(F.filter(joined, lambda x: x["p"]["hit"].isNotNull() & kind.stands(x["p"]["hit"])), span)
    return told if kind.base else F.filter(told, lambda s: s["score"] >= LEAST_SCORE)


def _hits(kind: Kind, text: Column) -> Column:
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(kind.sign)), hits) if kind.sign else hits


def find(docs: DataFrame, text_col: str = "text", result: str = "spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with the column ``result``: an array of spans (start, rank, end, kind, text, score, evidence) by start and rank."""
    docs = docs.drop(*(c for c in (result,) if c != text_col))
    names, n = docs.columns, range(len(kinds))
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(f"array<struct<{SPAN}>>")
    hits = docs.select(*names, *(_hits(k, text).alias(f"__h{i}") for i, k in enumerate(kinds)))
    # Most texts have no match of a kind; only others are split.
    zipped = [F.arrays_zip(F.split(text, k.pattern, -1).alias("gap"), F.col(f"__h{i}").alias("hit")) for i, k in enumerate(kinds)]
    parts = hits.select(*names, *(F.when(F.size(f"__h{i}") > 0, zipped[i]).alias(f"__p{i}") for i in n))
    length = lambda p: F.length(p["gap"]).cast("bigint") + F.coalesce(F.length(p["hit"]), F.lit(0))
    sums = parts.select("*", *(F.when(F.col(f"__p{i}").isNotNull(), running_sums(F.transform(f"__p{i}", length))).alias(f"__s{i}") for i in n))
    found = sums.select(*names, *(F.when(F.col(f"__p{i}").isNotNull(), _spans(k, i, F.col(f"__p{i}"), F.col(f"__s{i}"))).otherwise(none).alias(f"__f{i}") for i, k in enumerate(kinds)))
    base = F.concat(none, *(F.col(f"__f{i}") for i, k in enumerate(kinds) if k.base))
    sure = [F.col(f"__f{i}") for i, k in enumerate(kinds) if not k.base and k.checked]
    apart = [_apart(F.col(f"__f{i}"), base) for i, k in enumerate(kinds) if not k.base and not k.checked]
    return found.select(*(c for c in names if c != result), F.sort_array(F.concat(base, *sure, *apart)).alias(result))


def _apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``."""
    overlap = lambda s: lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])
    return F.when(F.size(spans) > 0, _bound(others, lambda all_: F.filter(spans, lambda s: ~F.exists(all_, overlap(s))))).otherwise(spans)


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(the id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and a digest of the base kinds, and all spans."""
    found = find(docs.select(F.col(id_col), F.col(text_col).alias("text")), "text", "found").select(id_col, "found")
    base = [k.name for k in KINDS if k.base]
    of = lambda name: F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    digest = F.sha2(listed(F.filter("found", lambda s: s["kind"].isin(*base))), 256)
    return found.select(id_col, *map(of, base), digest.alias("base_sha256"), listed(F.col("found")).alias("spans"))
