"""Personal data by weak supervision, in column expressions only.

Four kinds are found by fixed patterns. Other candidates (long runs, groups of digits, runs
of capitalised words) get the votes of labelers (patterns, gazetteers of names and places,
context). Words and numbers are judged apart: expectation-maximisation estimates how reliable each
labeler is from the counts of vote patterns, and the soft labels that follow train a
logistic span classifier, which decides over the candidates in all texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import stored

# Every pattern is linear in the text: a start that must fail is not tried again inside the
# same run, and possessive groups neither back off nor recurse. The matches are those of the
# plain forms beside them.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
EXTRA = ("secret", "number", "name")
"""Kinds of added spans: runs of letters and digits, digit groups, and names of persons."""

CANDIDATE = (
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+"
    r"|(?<![0-9.+(])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z_-])[0-9]{9,19}(?![0-9A-Za-z_-])"
    r"|(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])"
    r"|(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20[0-9A-Z]{4}){3,7}+(?:\x20[0-9A-Z]{1,3}(?![0-9A-Za-z]))?+"
)
CAPITALISED = r"\p{Lu}\p{Ll}++\x20\p{Lu}\p{Ll}"
CONTEXT = 40

CUES = (
    # Words before personal data, in four languages.
    "token key apikey secret password passwd pwd bearer auth login credential "
    "tel phone mobile cell fax call sms whatsapp contact "
    "card visa mastercard amex credit debit iban bic account acct ssn passport license tax "
    "telefon handy konto karte ausweis steuernummer kennwort passwort "
    "téléphone portable compte carte passeport clé "
    "teléfono móvil cuenta tarjeta pasaporte clave contraseña"
).split()
OTHER_CUES = "version vol volume page isbn issn doi chapter section figure table rev revision build seite kapitel chapitre página commit".split()


GIVEN_NAMES = (
    # Frequent given names in several languages.
    "Adam Alex Alexander Ali Alice Amy Ana Andrea Andreas Andrew Angela Anna Anne Antonio Barbara Ben Brian Carlos Carmen "
    "Catherine Charles Chris Christian Claire Claudia Daniel David Diana Edward Elena Elizabeth Emily Emma Eric Eva Fatima "
    "Frank George Hannah Hans Helen Henry Ivan Jack Jacques James Jan Jane Jean Jennifer Jessica Johannes John Jorge Jose Joseph "
    "Juan Julia Karen Karl Kate Katharina Kevin Laura Lena Linda Lisa Louis Lucas Luis Manuel Maria Marie Mark Martin Mary "
    "Matthew Max Michael Michel Miguel Mohammed Monica Nicole Olga Oliver Pablo Patricia Paul Pedro Peter Philip Pierre Rachel "
    "Richard Robert Rosa Samuel Sandra Sarah Simon Sofia Sophie Stefan Stephen Susan Thomas Tim Ursula Victor William Wolfgang"
).split()
NOT_NAMES = (
    # Places, calendar words and words of institutions and headings.
    "London Paris Berlin Madrid Rome Vienna Moscow York Chicago Boston Washington California Texas Florida Europe America Africa "
    "Asia Australia Canada China France Germany India Italy Japan Mexico Russia Spain England Ireland Scotland Kingdom States "
    "January February March April May June July August September October November December "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "License Licence Public General Apache Foundation University Institute College School Street Road Avenue Park River Lake "
    "Company Corporation Committee Council Department Ministry Bank Press Journal Software Project Chapter Section Table Figure "
    "The This That And Of To In On For With Und Der Die Das Sich Le La Les El Los"
).split()
TITLE_WORDS = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Sr Sra Señor Señora".split()
TITLES = r"(?<!\p{L})(?:" + "|".join(TITLE_WORDS) + r")\.?\x20$"
NAME_CUES = (
    # Words before names of persons.
    "name contact patient client customer employee owner author tenant applicant dear regards sincerely signed attn "
    "ansprechpartner kunde patientin nom prénom nombre apellido"
).split()

# Two or three capitalised words; a title or cue before them is not part of a name.
CANDIDATE += (
    rf"|(?<![\p{{L}}0-9_-])(?!(?:{'|'.join([*TITLE_WORDS, *(w.capitalize() for w in NAME_CUES)])})\x20)"
    r"\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++(?![\p{L}0-9_-])){1,2}"
)

IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, start: Column) -> Column:
    """``start`` and the running sums after it."""
    return F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running_sums(values: Column) -> Column:
    """0 and the running sums of a non-empty array of numbers, block by block: growing one
    array for all of a long text would copy it once per element."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))

    def whole(own: Column) -> Column:
        totals = F.transform(own, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        joined = F.flatten(F.zip_with(own, F.slice(_scan(totals, F.lit(0)), 1, F.size(own)), lambda b, at: F.slice(_scan(b, at), 2, F.size(b))))
        return F.concat(F.array(F.lit(0)), joined)

    return let(blocks, whole)


def find(text: Column, pattern: str) -> Column:
    """All matches, in order: ``start``, ``end`` (code points), ``hit``, ``left`` and ``right`` (text beside it)."""
    none = F.array().cast("array<struct<start: int, end: int, hit: string, left: string, right: string>>")

    def placed(hits: Column, between: Column) -> Column:
        sizes = F.flatten(F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda a, b: F.array(F.length(a), F.length(b))))
        return let(
            running_sums(sizes),
            lambda at: F.transform(
                hits,
                lambda h, i: F.struct(
                    F.get(at, 2 * i + 1).alias("start"),
                    F.get(at, 2 * i + 2).alias("end"),
                    h.alias("hit"),
                    F.substring(F.get(between, i), -CONTEXT, CONTEXT).alias("left"),
                    F.substring(F.get(between, i + 1), 1, 2).alias("right"),
                ),
            ),
        )

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda between: placed(hits, between))).otherwise(none),
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The checksum of a string of digits is right."""

    def part(i: Column) -> Column:
        d = F.substring(number, -i, 1).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    values = F.transform(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), part)
    return F.coalesce(F.aggregate(values, F.lit(0), lambda acc, x: acc + x) % 10 == 0, F.lit(False))


def iban(hit: Column) -> Column:
    """The check digits of an account number are right: the number is 1 modulo 97 once its first
    four characters have gone to its end and letters stand for 10 to 35."""
    plain = F.regexp_replace(hit, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    values = F.transform(F.split(moved, ""), lambda ch: F.when(ch.rlike("[0-9]"), ch.cast("int")).when(ch.rlike("[A-Z]"), F.ascii(ch) - 55))
    mod = F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0), lambda acc, v: (acc * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return mod == 1


def valid(kind: str, hit: Column) -> Column:
    n = F.length(digits(hit))
    if kind == "ip":
        return hit.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(hit))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _any(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike(r"(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})")


def votes(c: Column) -> list[tuple[str, Column]]:
    """Labelers: 1 for personal data, -1 against, 0 for no opinion."""
    hit, left, right = c["hit"], c["left"], c["right"]
    n = F.length(digits(hit))

    def vote(yes: Column, no: Column | None = None) -> Column:
        out = F.when(yes, 1)
        return (out.when(no, -1) if no is not None else out).otherwise(0)

    return [
        ("hex", vote(hit.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"))),
        ("mixed", vote(hit.rlike(r"^(?=.*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]{24,}$"), hit.rlike(r"[A-Za-z]{4,}-[A-Za-z]{3,}"))),
        ("phone", vote(hit.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"))),
        ("ssn", vote(hit.rlike(r"^(?!000|666|9)[0-9]{3}([\x20-])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}$"))),
        ("iban", vote(hit.rlike(r"^[A-Z]{2}[0-9]{2}\x20") & iban(hit))),
        ("luhn", vote(F.when(n.between(12, 19), luhn(digits(hit))).otherwise(False) & ~hit.rlike("[A-Za-z]"))),
        ("dull", vote(F.lit(False), digits(hit).rlike(r"^(.)\1*$|^0?123456789|000000"))),
        ("cue", vote(_any(left, CUES), _any(left, OTHER_CUES))),
        ("assigned", vote(left.rlike(r"[=:]\s*[\"']?$") & (right.rlike(r"^[\"']") | left.rlike(r"[=:]\s*$")))),
    ]


def _words(hit: Column) -> Column:
    return F.split(hit, " ")


def is_name(c: Column) -> Column:
    """The candidate is a run of capitalised words."""
    return ~c["hit"].rlike("[0-9]")


def _listed(hit: Column, words: list[str]) -> Column:
    return F.arrays_overlap(_words(hit), F.array(*[F.lit(w) for w in words]))


def name_votes(c: Column) -> list[tuple[str, Column]]:
    """Labelers of capitalised words, as in ``votes``. Such a run is nothing by itself: without
    a list or context that speaks for a person, the last one is against."""
    hit, left = c["hit"], c["left"]
    given = _words(hit)[0].isin(GIVEN_NAMES)
    titled = left.rlike(TITLES)
    cue = _any(left, NAME_CUES)
    return [
        ("given", F.when(given, 1).otherwise(0)),
        ("other", F.when(_listed(hit, NOT_NAMES), -1).otherwise(0)),
        ("title", F.when(titled, 1).otherwise(0)),
        ("cue", F.when(cue, 1).otherwise(0)),
        ("repeats", F.when(F.size(F.array_distinct(_words(hit))) < F.size(_words(hit)), -1).otherwise(0)),
        ("plain", F.when(given | titled | cue, 0).otherwise(-1)),
    ]


def name_features(c: Column) -> list[tuple[str, Column]]:
    hit, left, right = c["hit"], c["left"], c["right"]
    return [
        ("given", _words(hit)[0].isin(GIVEN_NAMES)),
        ("other", _listed(hit, NOT_NAMES)),
        ("title", left.rlike(TITLES)),
        ("cue", _any(left, NAME_CUES)),
        ("repeats", F.size(F.array_distinct(_words(hit))) < F.size(_words(hit))),
        ("three", F.size(_words(hit)) > 2),
        ("after_mark", left.rlike(r"[=:#,]\s*[\"']?$")),
        ("starts", left.rlike(r"(?:^|[.!?\n])\s*$")),
        ("ends", right.rlike(r"^(?:$|[,.;:\n<(])")),
    ]


def features(c: Column) -> list[tuple[str, Column]]:
    """What the classifier sees of a span: its own form and the characters beside it."""
    hit, left, right = c["hit"], c["left"], c["right"]
    return [
        ("letters", hit.rlike("[A-Za-z]")),
        ("lower_hex", hit.rlike("^[0-9a-fA-F]+$")),
        ("long", F.length(hit) >= 32),
        ("digits_only", hit.rlike("^[0-9]+$")),
        ("grouped", hit.rlike(r"[0-9][\x20.-][0-9]")),
        ("hyphened_words", hit.rlike("[A-Za-z]{3,}[-_][A-Za-z]{3,}")),
        ("after_mark", left.rlike(r"[=:#]\s*[\"']?$")),
        ("quoted", right.rlike("^[\"']")),
        ("cue", _any(left, CUES)),
        ("other_cue", _any(left, OTHER_CUES)),
    ]


def reliabilities(patterns: dict[tuple[int, ...], float], rounds: int = 100) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over counts of vote patterns.

    Returns the share of personal data and, per labeler, the probability of each vote given
    (other, personal). It starts from the majority of votes; pseudo-counts keep a labeler
    from being taken for worse than a coin.
    """
    if not patterns:
        return 0.5, []
    m = len(next(iter(patterns)))
    soft = {p: (sum(p) > 0) * 0.9 + (sum(p) == 0) * 0.3 + (sum(p) < 0) * 0.1 for p in patterns}
    prior, tables = 0.5, []
    for _ in range(rounds):
        total = sum(patterns.values())
        prior = min(max((sum(n * soft[p] for p, n in patterns.items()) + 1) / (total + 2), 0.01), 0.99)
        tables = []
        for j in range(m):
            counts = {v: [1.0 + (v == -1), 1.0 + (v == 1)] for v in (-1, 0, 1)}
            for p, n in patterns.items():
                counts[p[j]][0] += n * (1 - soft[p])
                counts[p[j]][1] += n * soft[p]
            sums = [sum(c[y] for c in counts.values()) for y in (0, 1)]
            tables.append({v: (c[0] / sums[0], c[1] / sums[1]) for v, c in counts.items()})
        new = {p: personal(p, prior, tables) for p in patterns}
        done = max(abs(new[p] - soft[p]) for p in patterns) < 1e-6
        soft = new
        if done:
            break
    return prior, tables


def personal(pattern: tuple[int, ...], prior: float, tables: list[dict[int, tuple[float, float]]]) -> float:
    """Probability of personal data given the votes."""
    z = math.log(prior / (1 - prior)) + sum(math.log(t[v][1] / t[v][0]) for v, t in zip(pattern, tables, strict=True))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def train(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 500) -> list[float]:
    """Logistic weights (bias first) from (features, soft label, count) rows, by gradient descent with L2."""
    if not rows:
        return []
    size = len(rows[0][0]) + 1
    w = [0.0] * size
    total = sum(n for _, _, n in rows)
    for _ in range(rounds):
        g = [1e-3 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, w[0] + sum(a for a, b in zip(w[1:], x, strict=True) if b)))))
            off = n / total * (p - y)
            g[0] += off
            for i, b in enumerate(x, 1):
                if b:
                    g[i] += off
        w = [a - 2.0 * b for a, b in zip(w, g, strict=True)]
    return w


def find_spans(docs: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base`` and ``added``, arrays of
    ``start, rank, end, kind`` in order (code points, end exclusive).

    Null and empty texts have no spans; repeated rows get equal ones. Added spans overlap no
    base span. The table of votes and features that reaches the driver has one row per
    combination (at most 3^9 times 2^10, a few dozen in practice), not per candidate; an
    empty one adds nothing. Names and other candidates have a model each.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def kind_of(rank: int, kind: str, spans: Column) -> Column:
        good = F.filter(spans, lambda s: valid(kind, s["hit"]))
        return F.transform(good, lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), s["end"], F.lit(kind).alias("kind")))

    has = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    number = F.col("text").rlike("[0-9]")
    none = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string>>")
    nothing = F.array().cast("array<struct<start: int, end: int, hit: string, left: string, right: string>>")
    kinds = [F.when(has.get(k, number), kind_of(i, k, find(F.col("text"), p))).otherwise(none) for i, (k, p) in enumerate(PATTERNS.items())]
    found = narrow.select(
        "doc_id", F.array_sort(F.flatten(F.array(*kinds))).alias("base"), F.when(number | F.col("text").rlike(CAPITALISED), find(F.col("text"), CANDIDATE)).otherwise(nothing).alias("found")
    )
    # Each text is searched once: what follows reads spans only.
    found = stored(docs.sparkSession, found, "spans")
    free = F.filter("found", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    found = found.select("doc_id", "base", free.alias("found"))

    c = F.col("c")
    each = found.select(F.explode("found").alias("c")).select(
        is_name(c).alias("name"),
        F.when(is_name(c), F.array(*[v for _, v in name_votes(c)])).otherwise(F.array(*[v for _, v in votes(c)])).alias("v"),
        F.when(is_name(c), F.array(*[f.cast("int") for _, f in name_features(c)])).otherwise(F.array(*[f.cast("int") for _, f in features(c)])).alias("f"),
    )
    table = sorted((r["name"], tuple(r["v"]), tuple(r["f"]), r["n"]) for r in each.groupBy("name", "v", "f").agg(F.count("*").alias("n")).collect())

    def chosen(s: Column, name: bool) -> Column:
        """The model of one sort of candidates, fitted on its votes, as a test of a span."""
        own = [(v, f, n) for is_one, v, f, n in table if is_one == name]
        if not own:
            return F.lit(False)
        patterns: dict[tuple[int, ...], float] = {}
        for v, _, n in own:
            patterns[v] = patterns.get(v, 0) + n
        prior, tables = reliabilities(patterns)
        weights = train([(f, personal(v, prior, tables), n) for v, f, n in own])
        seen = (name_features if name else features)(s)
        z = reduce(lambda a, b: a + b, [F.lit(weights[0]), *(F.when(f, w).otherwise(0.0) for w, (_, f) in zip(weights[1:], seen, strict=True))])
        return z > math.log(threshold / (1 - threshold))

    def placed(s: Column) -> Column:
        sort = F.when(is_name(s), 2).when(s["hit"].rlike("[A-Za-z]"), 0).otherwise(1)
        kind = F.element_at(F.array(*[F.lit(k) for k in EXTRA]), sort + 1)
        return F.struct(s["start"], (F.lit(len(KINDS)) + sort).alias("rank"), s["end"], kind.alias("kind"))

    added = F.transform(F.filter("found", lambda s: F.when(is_name(s), chosen(s, True)).otherwise(chosen(s, False))), placed)
    return found.select("doc_id", "base", added.alias("added"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
