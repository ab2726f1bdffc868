"""Personal data: candidate spans, boosted trees and calibrated thresholds, in DataFrame functions only.

Base spans come from fixed rules and always stay. High-recall generators propose further spans,
which may overlap one another and the base: anything around an at sign, also written out; runs of
digits with signs between them; four numbers with points in brackets. Each is proposed once for each
kind that its length allows. Gradient-boosted trees score them by format (digits, groups, signs,
check digit, shape) and context (neighbouring characters, words before).

The rules do not say what the trees learn. They are trained, here, on base spans of the table as
they might be damaged (the plus dropped, other signs, an at sign in words, points in brackets, fifteen
digits), which no rule finds, and on look-alikes (dates, versions, amounts, order and book numbers,
wrong check digits, addresses without a domain), each also with telling words before it; and on as
many made from the numbers up to ``SEEDS``, so that a small table has a model too. What the
generators find in the texts is neither: it is not held to be false. On a fifth of the documents,
not trained on, each kind's threshold is set where the precision is at least ``PRECISION``.
Candidates above it that overlap no base span are added; of those of a kind that overlap one another
the first, and of those that begin together the longest.

Features are small integers, so training needs only how many examples of each combination there are
and how many of these are true: at most ``CELLS`` lines, whatever the input. Candidates are found,
scored and cut out within their row: neither texts nor spans are exchanged. Every regular
expression runs in time linear in the text and without recursion; each is equal to the rule in its
comment on what passes that rule's checks.

Null and empty texts have no spans. Every row is judged by its own text, whatever its id: repeated
rows have equal results, null ids stay. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: Fixed rules, with what stands for them here.
RULES = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a rule to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]"}
#: Generators of candidates: around an at sign, an at sign in words, runs of digits, numbers with points in brackets.
GENERATORS = {
    "at": (r"(?:(?<![^\s@<>\"'(),;:])|\G)[^\s@<>\"'(),;:]++@[^\s@<>\"'(),;:]++", "@"),
    "written": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[({] ?(?:at|AT) ?[\])}] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) )[A-Za-z0-9-]++)++| (?:at|AT) [A-Za-z0-9-]++(?: (?:dot|DOT) [A-Za-z0-9-]++)++)", r"[\[({] ?(?:at|AT) ?[\])}]| (?:at|AT) [A-Za-z0-9-]++ (?:dot|DOT) "),
    "digits": (r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20()./-]{0,2}+[0-9])++(?![0-9A-Za-z])", r"[0-9][\x20()./-]{0,2}[0-9]"),
    "points": (r"(?<![0-9A-Za-z])[0-9]++(?: ?[\[(](?:\.|dot)[\])] ?[0-9]++)++(?![0-9A-Za-z])", r"[\[(](?:\.|dot)[\])]"),
}
CONTEXT = 24
PRECISION, ROUNDS, RATE, HELD, SEEDS = 0.995, 24, 0.3, 5, 200
#: Feature and number of its values; their product bounds the training table.
FEATURES = {"size": 8, "groups": 6, "signs": 6, "check": 2, "shape": 4, "lead": 3, "before": 3, "after": 3, "words": 6}
CELLS = math.prod(FEATURES.values()) * len(KINDS) * 2
#: Words before a span, by what they speak of (fixed values).
WORDS = [r"mail|contact|kontakt|correo|courriel", r"phone|tel|fon\b|call|t\u00e9l|m\u00f3vil|mobil|fax", r"card|visa|karte|tarjeta|carte|credit", r"\bip\b|host|server|addr", r"order|invoice|version|isbn|article|serial|date|total|page|\bno\b|\bnr\b"]
HIT = "struct<source:string,hit:string,before:string,after:string,start:bigint,end:bigint>"
SPAN = "struct<o:int,start:bigint,end:bigint,base:boolean>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _hits(text: Column, pattern: str, needs: str, source: str) -> Column:
    """Matches in order with their places in code points and their neighbourhood."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(found.alias("hit"), F.slice(gaps, F.lit(1), F.greatest(F.size(found), F.lit(0))).alias("gap"), F.slice(gaps, 2, F.size(found)).alias("next"))

    def add(state: Column, x: Column) -> Column:
        start = state["until"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(F.lit(source).alias("source"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(1)).alias("after"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("until"), F.concat(state["all"], F.array(one)).alias("all"))

    located = F.aggregate(zipped, F.struct(F.lit(0).cast("bigint").alias("until"), _none(HIT).alias("all")), add, lambda state: state["all"])
    return F.coalesce(F.when(text.rlike(needs), located), _none(HIT))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _small(numbers: Column) -> Column:
    return F.forall(numbers, lambda x: x.cast("double") <= 255)


def _passes(x: Column) -> Column:
    """The rules' checks on a match."""
    n = F.length(_digits(x["hit"]))
    return (
        F.when(x["source"] == "email", F.lit(True))
        .when(x["source"] == "ip", _small(F.split(x["hit"], r"\.")))
        .when(x["source"] == "card", n.between(16, 19) & F.call_function("luhn_check", _digits(x["hit"])))
        .otherwise(n.between(8, 15))
    )


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")


def _base(text: Column) -> Column:
    """The spans of the rules."""
    return F.filter(F.concat(*[_hits(text, RULES[k], NEEDS[k], k) for k in KINDS]), _passes)


def _proposed(text: Column) -> Column:
    return F.concat(*[_hits(text, p, needs, name) for name, (p, needs) in GENERATORS.items()])


def _kinds(x: Column) -> Column:
    """The kinds that a candidate may be of."""
    n = F.length(_digits(x["hit"]))
    four = F.size(F.split(x["hit"], r"[^0-9]+")) == 4
    digits = F.filter(F.array(F.when(n.between(13, 19), F.lit("card")), F.when(n.between(7, 15), F.lit("phone"))), lambda k: k.isNotNull())
    return F.when(x["source"].isin("at", "written"), F.array(F.lit("email"))).when(x["source"] == "points", F.when(four, F.array(F.lit("ip"))).otherwise(_none("string"))).otherwise(digits)


def _class(c: Column) -> Column:
    return F.when((F.length(c) == 0) | c.rlike(r"^\s"), 0).when(c.rlike(r"^[\p{L}\p{N}_]"), 1).otherwise(2)


def _features(x: Column, kind: Column) -> dict[str, Column]:
    hit = x["hit"]
    digits = _digits(hit)
    n, mail, points = F.length(digits), kind == "email", kind == "ip"
    parts = F.split(hit, r"[^0-9]+")
    domain = F.lower(F.element_at(F.split(hit, r"@|[\[({] ?(?:at|AT) ?[\])}] ?| (?:at|AT) "), -1))
    words = F.lower(x["before"])
    spoken = F.lit(0)
    for k in range(len(WORDS), 0, -1):
        spoken = F.when(words.rlike(WORDS[k - 1]), k).otherwise(spoken)
    dated = hit.rlike(r"^(?:(?:19|20)[0-9]{2}[./-]?[01]?[0-9][./-]?[0-3]?[0-9](?:[ ./-][0-9]{2}){0,3}|[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2} ?- ?(?:19|20)[0-9]{2}|(?:19|20)[0-9]{10,12})$")
    booked = hit.rlike(r"^97[89][ -]?[0-9]")
    return {
        "size": F.greatest(F.lit(0), F.least(F.lit(7), F.when(mail, F.length(hit) / 8).when(points, n - 4).when(kind == "card", n - 12).otherwise(n - 7))).cast("int"),
        "groups": F.when(mail, F.least(F.lit(5), F.size(F.split(domain, r" ?(?:\.|[\[({] ?(?:dot|\.) ?[\])}]| dot ) ?")) - 1)).otherwise(F.least(F.lit(5), F.size(parts) - F.when(hit.startswith("("), 2).otherwise(1))),
        "signs": F.when(mail, F.when(x["source"] == "at", 0).when(hit.rlike(r"[\[({] ?(?:at|AT)"), 1).otherwise(2)).when(hit.contains("("), 4).when(hit.contains("/"), 5).when(hit.contains("."), 3).when(hit.contains("-"), 2).when(hit.contains(" "), 1).otherwise(0),
        "check": F.when(mail, F.when(domain.rlike(r"[a-z]{2,}$"), 1)).when(~points & F.call_function("luhn_check", digits), 1),
        "shape": F.when(mail, F.when(~domain.rlike(r"\.|dot"), 0).when(domain.rlike(r"^[a-z0-9. -]+$"), 1).when(domain.rlike(r"[^\x00-\x7f]"), 3).otherwise(2)).when(points, F.when(_small(parts), 2).otherwise(3)).when(dated, 1).when(hit.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), 2).when(booked, 3),
        "lead": F.when(hit.rlike(r"^\(?00[^0]"), 2).when(hit.rlike(r"^\(?0"), 1),
        "before": _class(F.right(x["before"], F.lit(1))),
        "after": _class(x["after"]),
        "words": spoken,
    }


# ---------------------------------------------------------------- training
def _checked(prefix: Column) -> Column:
    """A number with its check digit."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(prefix, d.cast("string")))
    return F.element_at(F.filter(tries, lambda t: F.call_function("luhn_check", t)), 1)


def _examples(kind: Column, hit: Column) -> Column:
    """(source, hit, kind, true, words before) made from a base span: forms that no rule finds, and look-alikes."""
    d = _digits(hit)
    local, domain = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    spelled, stem = F.regexp_replace(domain, r"\.", " dot "), F.substring_index(domain, ".", 1)
    one = lambda source, text, kind, true, words="": F.struct(F.lit(source).alias("source"), text.alias("hit"), F.lit(kind).alias("kind"), F.lit(true).alias("true"), F.lit(words).alias("words"))
    cut = lambda c, *sizes: F.concat_ws("|", *[c.substr(F.lit(1 + sum(sizes[:k])), F.lit(n)) for k, n in enumerate(sizes)])  # noqa: E731  groups of a number
    signed = lambda c, sign: F.regexp_replace(c, r"\|", sign)
    mails = [
        *[one("written", F.concat(local, F.lit(at), F.regexp_replace(domain, r"\.", dot)), "email", True, words) for at, dot in ((" (at) ", "."), ("[at]", "."), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "(dot)"), (" [AT] ", " [DOT] ")) for words in ("", "mail ")],
        *[one("at", F.concat(local, F.lit("@\u00fc"), domain), "email", True, words) for words in ("", "mail ")],
        *[one("at", F.concat(local, F.lit("@"), end), "email", False, words) for words in ("", "no ") for end in (stem, F.concat(stem, F.lit("and"), stem), F.concat(stem, F.lit("-of-"), stem, F.lit("-and-"), stem))],
        one("at", F.concat(local, F.lit("@\u00fc"), stem), "email", False), one("at", F.concat(local, F.lit("@/"), stem), "email", False),
        *[one("written", F.concat(stem, stem, F.lit(at), stem, stem, F.lit(dot), F.lit("12")), "email", False, words) for at, dot in ((" (at) ", "."), (" at ", " dot "), ("[at]", ".")) for words in ("", "page ")],
    ]
    octets = F.split(hit, r"\.")
    ips = [
        *[one("points", F.array_join(octets, sign), "ip", True, words) for sign in ("[.]", "(.)", "[dot]", " [.] ") for words in ("", "server ", "ip ")],
        *[one("points", F.array_join(F.transform(octets, lambda x: (x.cast("int") + 256).cast("string")), sign), "ip", False, words) for sign in ("[.]", "(.)", "[dot]", " [.] ") for words in ("", "version ")],
        *[one("digits", hit, "phone", False, words) for words in ("", "server ", "version ", "call ")],
    ]
    wrong = lambda c: F.concat(c.substr(F.lit(1), F.length(c) - 1), ((F.right(c, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    numbers = F.struct(cut(d, 4, 4, 4, 4).alias("sixteen"), cut(_checked(F.left(d, F.lit(14))), 4, 6, 5).alias("fifteen"))
    cards = lambda sixteen, fifteen: [
        *[one("digits", signed(c, sign), "card", True, words) for c, signs in ((sixteen, (".", "/", "- ")), (fifteen, ("", " ", "-", "."))) for sign in signs for words in ("", "card ", "credit ")],
        *[one("digits", signed(wrong(c), sign), "card", False, words) for c in (sixteen, fifteen) for sign in ("", " ", "-", ".", "/") for words in ("", "order ", "card ")],
        *[one("digits", signed(fifteen, sign), "phone", False, words) for sign in ("", " ", "-") for words in ("", "card ")],
        *[one("digits", F.concat(F.lit("978-3-"), d.substr(2, 2), F.lit("-"), d.substr(4, 6), F.lit("-"), d.substr(10, 1)), "card", False, words) for words in ("", "isbn ")],
        *[one("digits", F.concat(F.lit("20240"), (d.substr(2, 1).cast("int") % 9 + 1).cast("string"), F.lit("1"), d.substr(3, 1), F.lit("1"), d.substr(4, 1), F.lit("2"), d.substr(5, 1), F.lit("3"), d.substr(6, 1)), "card", False, words) for words in ("", "date ")],
    ]
    phones = lambda tail: [
        *[one("digits", t, "phone", True, words) for t in (
            F.concat(F.lit("1 ("), tail.substr(1, 3), F.lit(") "), tail.substr(4, 3), F.lit("-"), tail.substr(7, 4)), F.concat(F.lit("("), tail.substr(1, 3), F.lit(") "), tail.substr(4, 3), F.lit("-"), tail.substr(7, 4)),
            signed(cut(tail, 3, 3, 4), "-"), F.concat(F.lit("1-"), signed(cut(tail, 3, 3, 4), "-")), F.concat(F.lit("0049 "), signed(cut(tail, 3, 7), " ")), F.concat(F.lit("0"), signed(cut(tail, 3, 7), "/")),
        ) for words in ("", "call ", "phone ", "tel ")],
        *[one("digits", t, "phone", True, words) for t in (signed(cut(tail, 3, 3, 4), " "), signed(cut(tail, 3, 3, 4), "."), tail) for words in ("call ", "phone ", "tel ")],
        *[one("digits", t, "phone", False, words) for t in (
            tail, F.concat(F.lit("00"), tail.substr(1, 8)), F.concat(F.lit("2024-0"), (tail.substr(1, 1).cast("int") % 9 + 1).cast("string"), F.lit("-1"), tail.substr(2, 1)),
            F.concat(F.lit("1"), tail.substr(1, 1), F.lit(".0"), (tail.substr(2, 1).cast("int") % 9 + 1).cast("string"), F.lit(".20"), tail.substr(3, 2)), F.concat(F.lit("19"), tail.substr(1, 2), F.lit("-20"), tail.substr(3, 2)),
            F.concat(F.lit("10."), tail.substr(1, 1), F.lit("."), tail.substr(2, 2), F.lit("."), tail.substr(4, 4)), F.concat(F.lit("1 "), signed(cut(tail, 3, 3), " ")), F.concat(tail.substr(1, 2), F.lit(" "), signed(cut(tail, 3, 3), " ")),
            F.concat(F.lit("978-3-"), tail.substr(1, 2), F.lit("-"), tail.substr(3, 6), F.lit("-"), tail.substr(9, 1)), signed(cut(tail, 1, 2, 2, 4), "."),
        ) for words in ("", "order ", "version ", "date ", "total ")],
    ]
    wide = "array<struct<source:string,hit:string,kind:string,true:boolean,words:string>>"
    # the parts that examples share are made once
    return F.when(kind == "email", F.array(*mails)).when(kind == "ip", F.array(*ips)).when(kind == "card", F.transform(F.array(numbers), lambda v: F.array(*cards(v["sixteen"], v["fifteen"])))[0]).otherwise(F.transform(F.array(F.right(F.concat(F.lit("5550"), d), F.lit(10))), lambda v: F.array(*phones(v)))[0]).cast(wide)


def _seeds(spark: SparkSession) -> DataFrame:
    """(kind, hit, before, after, held) of made spans, a fixed number."""
    lot = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**n)).cast("string")
    number = lambda salt, n: F.lpad(lot(salt, n), n, "7")
    pick = lambda salt, *of: F.element_at(F.array(*[F.lit(x) for x in of]), (F.pmod(F.xxhash64("id", F.lit(-salt)), F.lit(len(of))) + 1).cast("int"))
    made = F.array(
        F.struct(F.lit("email").alias("kind"), F.concat(pick(1, "jo", "user", "first.last", "a.very-long_name"), lot(1, 3), F.lit("@"), pick(2, "m", "mail", "web-office"), lot(2, 1), pick(3, ".de", ".org", ".example.com", ".co.uk")).alias("hit")),
        F.struct(F.lit("ip").alias("kind"), F.array_join(F.array(*[F.pmod(F.xxhash64("id", F.lit(10 + k)), F.lit(256)).cast("string") for k in range(4)]), ".").alias("hit")),
        F.struct(F.lit("card").alias("kind"), _checked(F.concat(F.lit("4"), number(3, 14))).alias("hit")),
        F.struct(F.lit("phone").alias("kind"), F.concat(F.lit("+1 ("), number(4, 3), F.lit(") 555-"), number(5, 4)).alias("hit")),
    )
    ends = F.element_at(F.array(*[F.lit(e) for e in (" ", ".", ",", "")]), (F.col("id") % 4 + 1).cast("int"))
    return spark.range(SEEDS).select(F.inline(made), F.lit("and then ").alias("before"), ends.alias("after"), (F.col("id") % HELD == 0).alias("held"))


def _cells(found: DataFrame) -> list:
    """The training table: (kind, held, features) with the numbers of true and false examples made of base spans (kind, hit, before, after, held)."""
    made = found.unionByName(_seeds(found.sparkSession)).withColumn("e", F.explode(_examples(F.col("kind"), F.col("hit")))).where("e.hit is not null")
    x = F.struct("e.source", "e.hit", F.concat("before", "e.words").alias("before"), "after")
    named = made.select("e.kind", "held", "e.true", x.alias("x"))
    valued = named.select("kind", "held", "true", *[F.coalesce(c, F.lit(0)).cast("int").alias(f) for f, c in _features(F.col("x"), F.col("kind")).items()])
    return valued.groupBy("kind", "held", *FEATURES).agg(F.count_if("true").alias("pos"), F.count_if(~F.col("true")).alias("neg")).orderBy("kind", "held", *FEATURES).collect()  # at most CELLS


def boosted(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Trees of two levels for combinations of features (rows of x) that come true and false so often: (feature, at most, left, right), where a side is a value or a stump of the same form."""
    trees, scores = [], np.zeros(len(x))

    def grow(mine: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        all_g, all_h = g[mine].sum(), h[mine].sum()
        best, at = 1e-9, None
        for f in range(x.shape[1] if depth else 0):
            sums = [np.bincount(x[mine, f], weights=w[mine]).cumsum()[:-1] for w in (g, h)]
            gain = sums[0] ** 2 / (sums[1] + 1) + (all_g - sums[0]) ** 2 / (all_h - sums[1] + 1) - all_g**2 / (all_h + 1)
            if len(gain) and gain.max() > best:
                best, at = gain.max(), (f, int(gain.argmax()))
        if at is None:
            return float(rate * all_g / (all_h + 1))
        low = x[mine, at[0]] <= at[1]
        return *at, grow(mine[low], g, h, depth - 1), grow(mine[~low], g, h, depth - 1)

    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-scores))
        trees.append(grow(np.arange(len(x)), pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p), 2))
        scores = scores + values_of(trees[-1], x)
    return trees


def values_of(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, at, left, right = tree
    return np.where(x[:, f] <= at, values_of(left, x), values_of(right, x))


def _sql(tree) -> str:
    """A tree as SQL over the features of ``v``."""
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, at, left, right = tree
    return f"IF(v.{list(FEATURES)[f]} <= {at}, {_sql(left)}, {_sql(right)})"


def calibrated(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    """The least score from which on the precision is high enough among held-out examples, equal scores being taken together; infinite if none is."""
    levels, where = np.unique(-np.round(score, 9), return_inverse=True)
    good, all_ = (np.bincount(where, weights=w).cumsum() for w in (pos, pos + neg))
    fine = np.flatnonzero((all_ >= 20) & (good >= PRECISION * all_))
    return float(-levels[fine[-1]]) if len(fine) else math.inf


def trained(found: DataFrame) -> dict[str, tuple[list, float]]:
    """Trees and threshold of each kind, from base spans (kind, hit, before, after, held) of a table."""
    lines, models = _cells(found), {}
    for kind in KINDS:
        part = {}
        for held in (False, True):
            mine = [r for r in lines if r["kind"] == kind and r["held"] == held]
            part[held] = np.array([[r[f] for f in FEATURES] for r in mine], np.int64).reshape(-1, len(FEATURES)), *(np.array([r[k] for r in mine], float) for k in ("pos", "neg"))
        trees = boosted(*part[False])
        x, pos, neg = part[True]
        models[kind] = trees, calibrated(sum((values_of(t, x) for t in trees), np.zeros(len(x))), pos, neg)
    return models


# ---------------------------------------------------------------- spans
def _apart(spans: Column, fixed: Column) -> Column:
    """Of spans of a kind that overlap, the first and longest; none that overlaps a fixed one."""
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = F.filter(spans, lambda s: ~F.exists(fixed, lambda f: meets(s, f)))
    ordered = F.transform(F.array_sort(F.transform(free, lambda s: F.struct(s["o"].alias("o"), s["start"].alias("start"), (-s["end"]).alias("less")))), lambda s: F.struct(s["o"].alias("o"), s["start"].alias("start"), (-s["less"]).alias("end"), F.lit(False).alias("base")))
    return F.aggregate(ordered, _none(SPAN), lambda kept, s: F.when((F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1))["o"] == s["o"]) & meets(F.try_element_at(kept, F.lit(-1)), s), kept).otherwise(F.concat(kept, F.array(s))))


def _with_spans(rows: DataFrame, models: dict[str, tuple[list, float]]) -> DataFrame:
    """Rows with base spans and proposals as ``rules`` and ``proposals``: their base and added spans, as ``SPAN``, in place of these."""

    def valued(x: Column) -> Column:
        features = lambda k: [F.coalesce(c, F.lit(0)).cast("int").alias(f) for f, c in _features(x, k).items()]
        return F.transform(_kinds(x), lambda k: F.struct(_order(k).alias("o"), x["start"].alias("start"), x["end"].alias("end"), F.lit(False).alias("base"), *features(k)))

    tests = [f"WHEN {k + 1} THEN {' + '.join(map(_sql, trees))} >= {limit - 1e-6!r}D" for k, (trees, limit) in enumerate(map(models.get, KINDS)) if trees and limit < math.inf]
    wanted = f"filter(candidates, v -> CASE v.o {' '.join(tests)} ELSE false END)" if tests else "slice(candidates, 1, 0)"
    fixed = F.transform("rules", lambda x: F.struct(_order(x["source"]).alias("o"), x["start"].alias("start"), x["end"].alias("end"), F.lit(True).alias("base")))
    found = rows.withColumn("candidates", F.flatten(F.transform("proposals", valued))).withColumn("candidates", F.expr(wanted)).withColumn("rules", fixed)
    plain = F.transform("candidates", lambda v: F.struct(v["o"].alias("o"), v["start"].alias("start"), v["end"].alias("end"), v["base"].alias("base")))
    return found.withColumn("spans", F.concat("rules", _apart(plain, F.col("rules")))).drop("rules", "proposals", "candidates")


def _found(base: Column, mark: Column, rows: DataFrame) -> DataFrame:
    """Base spans of a table as ``trained`` takes them."""
    x = F.explode(base).alias("x")
    return rows.select(x, (F.pmod(mark, F.lit(HELD)) == 0).alias("held")).select(F.col("x.source").alias("kind"), "x.hit", "x.before", "x.after", "held")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["o"]), x["start"], x["end"])))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", models: Callable[[DataFrame], dict] = trained) -> DataFrame:
    """doc_id and spans (kind's number from 1, start, end, whether it is a base span) of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    scanned = written(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("mark"), _base(body).alias("rules"), _proposed(body).alias("proposals")), "scanned")
    return _with_spans(scanned, models(_found(F.col("rules"), F.col("mark"), scanned))).select("doc_id", "spans")


def digest(docs: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans of every document; then how many spans there are."""
    count = lambda o: F.size(F.filter("spans", lambda x: (x["o"] == o) & x["base"])).cast("bigint")
    return personal_data(docs).select(
        "doc_id", *[count(k + 1).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_listed(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"),
    )


def redacted(docs: DataFrame, text: str = "text", models: Callable[[DataFrame], dict] = trained) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, all columns kept, whatever these are named; overlapping spans become one, of the first's kind. ``n_chars`` follows the text."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    body = F.coalesce(docs[text], F.lit(""))
    given = docs.select(whole, body.alias("body"))
    model = models(_found(F.col("base"), F.col("mark"), docs.select(_base(body).alias("base"), F.xxhash64(body).alias("mark"))))
    spans = _with_spans(given.withColumn("rules", _base(F.col("body"))).withColumn("proposals", _proposed(F.col("body"))), model)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["o"].alias("o"))))
    island = "struct<start:bigint,less:bigint,o:int>"

    def fuse(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        longer = F.struct(last["start"].alias("start"), F.least(last["less"], s["less"]).alias("less"), last["o"].alias("o"))
        return F.when((F.size(kept) > 0) & (s["start"] < -last["less"]), F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(longer))).otherwise(F.concat(kept, F.array(s)))

    cut = spans.withColumn("cuts", F.aggregate(ordered, _none(island), fuse))
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    body = F.col("body")
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("cuts", lambda x: -x["less"]))
    kept = F.transform(F.arrays_zip(F.col("cuts").alias("cut"), F.slice(ends, F.lit(1), F.size("cuts")).alias("after")), lambda x: F.concat(body.substr(x["after"].cast("int") + 1, (x["cut"]["start"] - x["after"]).cast("int")), F.element_at(name, x["cut"]["o"])))
    changed = F.concat(F.concat_ws("", kept), body.substr((F.element_at(ends, -1) + 1).cast("int"), F.length(body)))
    new = F.when(F.size("cuts") == 0, F.col("row")[text]).otherwise(changed)
    out = []
    for field in docs.schema.fields:
        column = F.col("row")[field.name]
        if field.name == text:
            column = new
        elif field.name == "n_chars":
            column = F.when(F.size("cuts") == 0, column).otherwise(F.length(changed).cast(field.dataType))
        out.append(column.alias(field.name))
    return cut.select(*out)
