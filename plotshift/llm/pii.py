"""Personal data: expressions propose spans, checksums confirm them, context words adjust a score. Native functions only.

``split`` and ``regexp_extract_all`` with one expression give the texts between and of its matches, in order; their
lengths give every match's place in code points. Expressions are written so that no text makes them backtrack or recurse:
runs are possessive, and an attempt starts only where a run of its characters starts or the last match ended, which finds
the same leftmost matches. A kind is looked for only in texts that hold one of its characters. Everything happens in the
row: no shuffle, no Python.

Kinds: ``email``, ``ip``, ``card`` (Luhn) and ``phone`` by their stated rules, and as additions ``iban`` (mod 97) and
``card_part``: a card number of 13 to 19 digits in groups that passes Luhn inside a longer run of digits whose whole
failed. Context words within ``CONTEXT`` characters before a span raise its score.

Defined cases: a null text counts as empty and has no spans; rows are judged one by one, repeated ones alike; extra
columns are carried along by ``find``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
#: Spans are gathered in blocks of so many: appending to one long array would copy it for every match.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """``hint``: what a text must contain for the expression to be tried; ``score`` without and ``near`` with context;
    ``shortest``: length below which no match can be confirmed."""

    name: str
    pattern: str
    hint: str
    words: tuple[str, ...]
    score: float
    near: float
    shortest: int = 1


_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", ("mail", "contact", "write"), 0.9, 1.0),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", ("ip", "address", "host", "server"), 0.6, 0.9),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", ("card", "visa", "credit", "payment"), 0.8, 1.0, 13),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", ("phone", "call", "tel", "mobile"), 0.7, 1.0, 10),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[0-9][0-9]", ("iban", "account", "konto", "bank"), 0.9, 1.0),
    Kind(
        "card_part",
        r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
        "[0-9][0-9]",
        ("card", "visa", "credit", "payment"),
        0.6,
        0.9,
    ),
)
BASE = ("email", "ip", "card", "phone")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The sum of the digits, every second one from the right doubled and cast out, is a multiple of ten."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice")),
        lambda acc, d: F.struct(
            (
                acc["sum"]
                + F.when(d == "", F.lit(0)).when(
                    acc["twice"], (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")
                ).otherwise(d.cast("int"))
            ).alias("sum"),
            (~acc["twice"]).alias("twice"),
        ),
        lambda acc: acc["sum"],
    )
    return total % 10 == 0


def mod_97(match: Column) -> Column:
    """The number made of the account's characters, the first four at the end and letters as 10 to 35, leaves 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind in ("card", "card_part"):
        return F.length(_digits(match)).between(13, 19) & luhn(F.substring(_digits(match), 1, 19))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod_97(match)
    return F.lit(True)


def _matches(df: DataFrame, kind: Kind) -> DataFrame:
    """Adds ``m_<kind>``: start, end and text of every match of the expression; null where the text cannot hold one."""
    hint = F.col("p_text").rlike(kind.hint) if len(kind.hint) > 1 else F.col("p_text").contains(kind.hint)
    df = df.withColumn("p_found", F.when(hint, F.regexp_extract_all("p_text", F.lit(kind.pattern), F.lit(0))))
    df = df.withColumn("p_gaps", F.when(F.size("p_found") > 0, F.split("p_text", kind.pattern, -1)))
    step = "struct<s:int,e:int,m:string>"

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(F.element_at("p_gaps", x["i"] + 1))
        end = start + F.length(x["m"])
        span = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"))
        full, long_enough = F.size(acc["block"]) >= BLOCK, F.length(x["m"]) >= kind.shortest
        return F.struct(
            end.alias("at"),
            F.when(~long_enough, acc["block"]).when(full, F.array(span)).otherwise(F.array_append(acc["block"], span)).alias("block"),
            F.when(long_enough & full, F.array_append(acc["blocks"], acc["block"])).otherwise(acc["blocks"]).alias("blocks"),
        )

    steps = F.aggregate(
        F.transform("p_found", lambda m, i: F.struct(m.alias("m"), i.alias("i"))),
        F.struct(
            F.lit(0).alias("at"),
            F.array().cast(f"array<{step}>").alias("block"),
            F.array().cast(f"array<array<{step}>>").alias("blocks"),
        ),
        add,
        lambda acc: F.flatten(F.array_append(acc["blocks"], acc["block"])),
    )
    return df.withColumn(f"m_{kind.name}", F.when(F.size("p_gaps") > 0, steps)).drop("p_found", "p_gaps")


def _spans(kind: Kind) -> Column:
    """The confirmed matches of one kind with their score."""

    def near(x: Column) -> Column:
        before = F.substr(F.col("p_text"), F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
        return F.lower(before).rlike(r"\b(?:" + "|".join(kind.words) + ")")

    hits = F.filter(f"m_{kind.name}", lambda x: _confirmed(kind.name, x["m"]))
    if kind.name == "card_part":  # what the whole run already gave is not said twice
        hits = F.filter(hits, lambda x: ~F.exists("s_card", lambda c: (c["s"] < x["e"]) & (x["s"] < c["e"])))
    spans = F.transform(
        hits,
        lambda x: F.struct(
            F.lit(kind.name).alias("kind"),
            x["s"].alias("s"),
            x["e"].alias("e"),
            F.when(near(x), F.lit(kind.near)).otherwise(F.lit(kind.score)).alias("score"),
            F.lit(kind.name in BASE).alias("base"),
        ),
    )
    return F.coalesce(spans, F.array().cast("array<struct<kind:string,s:int,e:int,score:double,base:boolean>>"))


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``pii``: array of (kind, start, end, score, base), kinds in their order and each kind by start."""
    columns = [f"`{c}`" for c in df.columns]
    out = df.withColumn("p_text", F.coalesce(F.col(text), F.lit("")))
    for kind in KINDS:
        out = _matches(out, kind)
    for kind in KINDS:
        out = out.withColumn(f"s_{kind.name}", _spans(kind))
    return out.select(*columns, F.concat(*[f"s_{k.name}" for k in KINDS]).alias("pii"), *[F.size(f"s_{k}").cast("bigint").alias(f"n_{k}") for k in BASE])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the stated kinds, a digest of their spans, all spans, and the highest score."""
    out = find(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        *[f"n_{k}" for k in BASE],
        F.sha2(_joined(F.filter("pii", lambda x: x["base"])), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda x: x["score"])), F.lit(0.0)).alias("top_score"),
    )
