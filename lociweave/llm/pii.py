"""Personal data by proposal, checksum and context, with DataFrame functions alone.

Patterns propose spans; part ranges, Luhn and mod-97 confirm them; words close before a span move its score. Base spans
follow the contract's definitions. Two more sources add spans: IBANs, and stricter card and phone forms that a base match
swallowed whole and then failed on, such as a card number right after a phone number.

Defined cases: a null text counts as empty; empty texts have no spans; repeated rows are each scanned; an empty table gives
an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

# Proposals, for Java's matcher. (?:(?<!x)|\G) starts a match only where a run of x starts or the last match
# ended, which is where the leftmost match starts anyway; without it long runs would be scanned from each of their places.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN_HEAD = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
IBAN = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+"
STRICT_CARD = r"(?<![0-9])(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([\x20-]?)[0-9]{6}\2[0-9]{5})(?![0-9])"
STRICT_PHONE = r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

# Words that speak for a kind, and a kind's score without them.
CONTEXT = {
    "email": (0.8, "mail|contact|write|reach"),
    "ip": (0.6, "ip|address|host|server|addr"),
    "card": (0.7, "card|visa|credit|pay|amex|debit"),
    "phone": (0.6, "phone|call|tel|mobile|fax|contact"),
    "iban": (0.8, "iban|bank|account|transfer"),
}
AGAINST = "version|release|order|isbn|serial|build"
NEAR = 48  # code points before a span that count as its context


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """number: digits only. The sum of its digits, every second one from the right doubled and reduced, divides by ten."""
    places = F.sequence(F.lit(1), F.length(number))

    def part(i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(places, part), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """The account number with its first four characters moved to the end, letters as 10 to 35, leaves 1 divided by 97."""
    plain = F.regexp_replace(iban, r"\x20", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def ibans(text: Column, blocks: Column) -> Column:
    """Account numbers as S.SPAN. Words in capitals or numbers may follow one after a space, or a like beginning precede it: mod-97
    is tried from each beginning to each end that no letter or digit follows, the longest first."""

    def whole(head: Column) -> Column:
        return S.bound(S.part(blocks, head["start"], head["start"] + 69), lambda window: best(head, window))  # the longest run and one more

    def best(head: Column, window: Column) -> Column:
        run = F.regexp_extract(window, IBAN, 0)
        ends = F.filter(F.sequence(F.length(run), F.lit(15), F.lit(-1)), lambda n: F.substring(window, n, F.lit(2)).rlike("^[A-Z0-9](?![A-Za-z0-9])"))
        good = F.filter(ends, lambda n: (F.length(F.regexp_replace(F.substring(window, F.lit(1), n), r"\x20", "")) >= 15) & mod97(F.substring(window, F.lit(1), n)))
        size = F.get(good, F.lit(0))
        return F.struct(F.lit("iban").alias("kind"), head["start"].alias("start"), (head["start"] + size).alias("end"), F.substring(window, F.lit(1), size).alias("text"))

    found = F.filter(F.transform(S.spans(text, "iban", IBAN_HEAD), whole), lambda s: s["end"].isNotNull())

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["start"] >= at, s["end"]).otherwise(at), F.when(s["start"] >= at, s)

    return F.filter(S.running(found, F.lit(0), "int", S.SPAN[6:-1], step), lambda s: s.isNotNull())


def octets(s: Column) -> Column:
    """Each part, leading zeros aside, is at most 255."""
    return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, more, scored) for each row: spans, and each span's kind, place and score from 0 to 1."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = F.col("_text")

    def length_of(s: Column) -> Column:
        return F.length(digits(s["text"]))

    email = S.spans(t, "email", EMAIL, F.contains(t, F.lit("@")))
    ip = F.filter(S.spans(t, "ip", IP, F.contains(t, F.lit("."))), lambda s: octets(s["text"]))
    card = F.filter(S.spans(t, "card", CARD), lambda s: F.when(length_of(s).between(14, 19), luhn(digits(s["text"]))).otherwise(F.lit(False)))
    phone = F.filter(S.spans(t, "phone", PHONE, F.contains(t, F.lit("+"))), lambda s: length_of(s).between(10, 15))
    iban = ibans(t, F.col("_blocks"))
    card2 = F.filter(S.spans(t, "card", STRICT_CARD), lambda s: luhn(digits(s["text"])))
    phone2 = F.filter(S.spans(t, "phone", STRICT_PHONE, F.contains(t, F.lit("+"))), lambda s: length_of(s).between(10, 15))

    # blocks serve what is looked up by place; most texts have nothing to look up
    some = t.rlike(f"{EMAIL}|{IP}|{CARD}|{PHONE}|{IBAN_HEAD}")
    found = docs.select(F.col(id_col).alias("id"), text.alias("_text")).withColumn("_blocks", F.when(some, S.blocks(t)).otherwise(F.array().cast("array<string>")))
    found = found.select("id", "_blocks", email.alias("email"), ip.alias("ip"), card.alias("card"), phone.alias("phone"), iban.alias("iban"), card2.alias("card2"), phone2.alias("phone2"))
    base = F.concat("email", "ip", "card", "phone")
    found = found.select("id", "_blocks", base.alias("base"), F.concat("iban", "card2", "phone2").alias("more")).withColumn("more", S.not_over(F.col("more"), F.col("base")))

    def score(s: Column) -> Column:
        return S.bound(F.lower(S.part(F.col("_blocks"), F.greatest(s["start"] - NEAR, F.lit(0)), s["start"])), lambda near: judged(s, near))

    def judged(s: Column, near: Column) -> Column:
        by_kind = F.coalesce(*[F.when(s["kind"] == k, F.lit(p) + F.when(near.rlike(rf"\b(?:{words})"), 0.2).otherwise(0.0)) for k, (p, words) in CONTEXT.items()])
        return F.round(F.greatest(by_kind - F.when(near.rlike(rf"\b(?:{AGAINST})\b"), 0.3).otherwise(0.0), F.lit(0.0)), 2)

    every = F.concat("base", "more")
    return found.select(F.col("id").alias(id_col), "base", "more", F.transform(every, lambda s: F.struct(s["kind"], s["start"], s["end"], score(s).alias("score"))).alias("scored"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base, every = F.col("base"), F.concat("base", "more")
    return found.select(
        id_col,
        *[S.count_of(base, k).alias(f"n_{k}") for k in BASE],
        F.sha2(S.in_order(base, list(KINDS)).cast("binary"), 256).alias("base_sha256"),
        S.in_order(every, list(KINDS)).alias("spans"),
        F.array_max(F.transform("scored", lambda s: s["score"])).alias("top_score"),
    )
