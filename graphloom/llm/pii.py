"""Personal data in texts: patterns, and spans that weakly supervised labelers add.

Base spans are the leftmost matches of each kind's pattern that pass its check. Matches that fail it, and
the matches of a looser pattern for each kind outside of all these, are candidates too. Labelers vote on every
candidate (1 for, -1 against, 0 abstains): the base pattern, a check of its digits or parts, a gazetteer, words before
it that speak for the kind, and signs before it that speak against (up to CONTEXT characters, after the candidate
before it). Nobody knows the truth, so expectation-maximisation over the votes of the whole corpus estimates how
reliable each labeler is for each kind (Dawid and Skene 1979). The posteriors then train the final classifier, naive
Bayes over votes and shape, which decides on every candidate that is no base span; those that fail the check
of their kind are never added.

Everything that sees rows is built of column expressions. The driver gets one row for each combination of
kind, votes and shape (at most 4 * 2 * 3**5 * 2**3), whatever the corpus. Texts are searched once; the candidates are kept
in the shared folder while the classifier is trained.

The patterns are written without nested repeats, so that they take time in proportion to the text and no
stack: separators between digits, and dots between parts of a name, are marked first by single characters.
A private-use mark that a text holds already is put out of the way, one character for one. Places come from the lengths
of matches and of the gaps between them, never by walking a text from its start for each span.

Null and empty texts have no spans (a null text stays null when redacted). Places are counted in code points. Of
equal places in several kinds (ties) each stands under its own kind. Rows are independent once the classifier is
trained: equal rows give equal results, an empty table gives an empty result, and columns not named in the call are
left alone whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
MARK, DOT, FILL, AWAY = "", "", "", ""
LOCAL = f"A-Za-z0-9._%+{DOT}-"
#: The base patterns, in the form described above.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": rf"[0-9][0-9{MARK}]+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern to match and pass.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][ -]?){15}[0-9]", "phone": "+"}
LOOSE = {
    "email": r"[A-Za-z0-9_%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63} ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z]{2,24}",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,4})(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
#: Short patterns that a text must hold for the loose ones to match; they are quick to rule out.
LOOSE_NEEDS = {"email": r"[\[(](?:at|AT)[\])]", "ip": "[0-9A-Fa-f]::?[0-9A-Fa-f]", "card": "[0-9]{4}[ .-]?[0-9]{4}", "phone": "[0-9][.-][0-9]{4}"}
#: Words before a candidate, and signs right before it.
FOR = {
    "email": r"(?i)mail|contact|write|reach|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|adresse",
    "card": r"(?i)card|visa|amex|credit|karte|carte|tarjeta|pay",
    "phone": r"(?i)phone|call|\btel|mobile|fax|whatsapp|anruf|appel",
}
AGAINST = r"(?i)(?:version|isbn|order|build|serial|invoice|part no|\bv)[ .:#]*$|[=#/$_]$"
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|co|us|ch|at|it|nl)$",
    "ip": r"^(?:2|fd|fe)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|6)",
    "phone": r"^(?:\+[1-9]|\(?[2-9])",
}
#: Of matches of the base patterns with fewer digits nobody needs to vote.
LEAST_DIGITS, LONGEST = {"card": 13, "phone": 7}, 32
VOTES = ("pattern", "check", "gazetteer", "context", "signs")
SHAPES = ("spaced", "long", "line_start")
CONTEXT = 40
#: Elements of an array, and characters of a text, that are handled at once.
BLOCK, CHUNK = 256, 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once, however often the body (or a function in it) asks for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What `join` makes of 0 and the elements before each element; in blocks, so that no long array is copied for each element."""
    zero = F.array(F.lit(0).cast("long"))
    grow = lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x)))
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int") - 1), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
    sums = lambda v: F.transform(blocks(v), lambda b: F.aggregate(b, zero, grow))
    before = lambda own: F.slice(F.aggregate(F.transform(own, lambda b: F.element_at(b, -1)), zero, grow), F.lit(1), F.size(own))
    moved = lambda own: F.flatten(F.zip_with(before(own), own, lambda o, b: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: join(x, o))))
    return _let(values, lambda v: _let(sums(v), moved))


def _spans(text: Column, pattern: str) -> Column:
    """Of all matches: start, end (long, code points), the matching string, and up to CONTEXT characters between it and the match before."""
    gap = lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("n"), m.alias("m"), F.right(g, F.lit(CONTEXT)).alias("before"))
    steps = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, gap))
    place = lambda x, o: F.struct((o + x["g"]).alias("start"), (o + x["g"] + x["n"]).alias("end"), x["m"].alias("m"), x["before"].alias("before"))
    whole = lambda s: F.zip_with(s, _scan(F.transform(s, lambda x: x["g"] + x["n"]), lambda a, b: a + b), place)
    return _let(steps, lambda s: F.when(F.size(s) > 0, whole(s)).otherwise(_none()))


def _none() -> Column:
    return F.from_json(F.lit("[]"), "array<struct<start:long,end:long,m:string,before:string>>")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Of at most LONGEST digits; more are no card number."""
    code = F.split(F.reverse(digits), "(?!$)")
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    weighed = lambda x, k: F.when(k % 2 == 1, double(x.try_cast("int"))).otherwise(x.try_cast("int"))
    added = lambda c: F.aggregate(F.transform(c, weighed), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return (F.length(digits) > 0) & (F.length(digits) <= LONGEST) & (added(code) % 10 == 0)


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(m, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
    return _let(_digits(m), lambda d: F.length(d).between(16, 19) & _luhn(d) if kind == "card" else F.length(d).between(8, 15))


def _prepared(text: Column) -> Column:
    return F.when(text.rlike(f"[{MARK}-{FILL}]"), F.translate(text, MARK + DOT + FILL, AWAY * 3)).otherwise(text)


def _marked(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    return F.regexp_replace(text, "(?<=[0-9])[ -](?=[0-9])", MARK) if kind == "card" else text


def _masked(text: Column, pattern: str) -> Column:
    """The text with every match blotted out, character for character."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit(FILL), F.length(m)), F.lit("")))), "")


def _candidates(docs: DataFrame, carry: list[str], text: str) -> DataFrame:
    """The `carry` columns in a struct `row`, and spans: every candidate's kind, place, whether it's a base span, votes and shape."""
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.lit(0).alias("none"))
    step = docs.select(kept.alias("row"), _prepared(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("text"))
    needs = {k: (F.contains(F.col("text"), F.lit(NEEDS[k])) if k in ("email", "phone") else F.col("text").rlike(NEEDS[k])) for k in KINDS}
    step = step.select("row", "text", *[F.when(needs[k], _marked(k, F.col("text"))).alias(f"m_{k}") for k in KINDS])
    rest = lambda k: F.when(F.col(f"m_{k}").isNotNull(), _masked(F.col(f"m_{k}"), BASE[k]))
    plain = lambda k, c: F.translate(c, DOT, ".") if k == "email" else F.translate(c, MARK, " ") if k == "card" else c
    found = lambda k: F.coalesce(F.when(F.col(f"m_{k}").isNotNull(), _spans(F.col(f"m_{k}"), BASE[k])), _none())
    remains = [F.coalesce(plain(k, rest(k)), F.col("text")).alias(f"r_{k}") for k in KINDS]
    step = step.select("row", *[found(k).alias(f"all_{k}") for k in KINDS], *remains)
    loose = lambda k: F.when(F.col(f"r_{k}").rlike(LOOSE_NEEDS[k]), _spans(F.col(f"r_{k}"), LOOSE[k])).otherwise(_none())
    step = step.select("row", *[f"all_{k}" for k in KINDS], *[loose(k).alias(f"loose_{k}") for k in KINDS])

    def judged(k: str, column: str, matches: bool) -> Column:
        some = F.filter(column, lambda s: F.length(_digits(s["m"])) >= LEAST_DIGITS[k]) if matches and k in LEAST_DIGITS else F.col(column)
        return F.transform(some, lambda s: _judged(k, s, matches))

    return step.select("row", F.concat(*[judged(k, f"all_{k}", True) for k in KINDS], *[judged(k, f"loose_{k}", False) for k in KINDS]).alias("spans"))


def _judged(kind: str, s: Column, matches: bool) -> Column:
    """A candidate's kind, place, votes and shape; matches: of the base pattern. It's a base span if it passes too."""
    m, before = F.translate(s["m"], DOT + MARK, ". "), F.translate(s["before"], DOT + MARK, ". ")
    passes = _passes(kind, m) if matches else F.lit(False)
    return _let(F.struct(m.alias("m"), before.alias("before"), _digits(m).alias("digits"), passes.alias("passes")), lambda v: _voted(kind, s, v, matches))


def _voted(kind: str, s: Column, v: Column, matches: bool) -> Column:
    m, before, digits = v["m"], v["before"], v["digits"]
    check = v["passes"] if matches and kind != "email" else {
        "email": F.length(m) <= 254,
        "ip": (F.size(F.split(m, ":")) == 8) | m.contains("::"),
        "card": _luhn(digits) & (F.length(digits) >= 13),
        "phone": F.length(digits).between(8, 15) & ~digits.rlike(r"^(.)\1+$"),
    }[kind]
    ending = F.regexp_replace(m, r"[\])] ?(?=[A-Za-z]+$)", ".") if kind == "email" else digits if kind == "card" else m
    sign = lambda c: F.when(c, 1).otherwise(-1)
    said = {
        "pattern": F.lit(1 if matches else 0), "check": sign(check), "gazetteer": sign(ending.rlike(GAZETTEER[kind])),
        "context": F.when(before.rlike(FOR[kind]), 1).otherwise(0), "signs": F.when(before.rlike(AGAINST), -1).otherwise(0),
        "spaced": m.rlike(r"[ ()-]").cast("int"), "long": (F.length(m) > 20).cast("int"), "line_start": ((s["start"] == 0) | before.rlike(r"\n$")).cast("int"),
    }
    return F.struct(F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), v["passes"].alias("base"), *[c.cast("int").alias(n) for n, c in said.items()])


@dataclass(frozen=True)
class Model:
    """Naive Bayes: log odds at the start, and for each value of each feature, by kind."""

    start: dict[str, float]
    weight: dict[str, dict[tuple[str, int], float]]

    def log_odds(self, kind: str, features: dict[str, Column]) -> Column:
        total = F.lit(self.start[kind])
        for name, column in features.items():
            step = F.lit(0.0)
            for value in (-1, 0, 1):
                step = F.when(column == value, F.lit(self.weight[kind].get((name, value), 0.0))).otherwise(step)
            total = total + step
        return total


def reliabilities(table: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], list[float]]:
    """Dawid and Skene for one kind: the share of true candidates, each labeler's vote probabilities
    (given a true and a false candidate), and the posterior of each row of (votes, count)."""
    agree = [sum(v for v in votes) for votes, _ in table]
    post = [1 / (1 + math.exp(-1.5 * a + 1.0)) for a in agree]
    share, probs = 0.5, []
    total = sum(n for _, n in table)
    for _ in range(rounds):
        true = sum(p * n for p, (_, n) in zip(post, table))
        share = (true + 1) / (total + 2)
        probs = []
        for k in range(len(VOTES)):
            seen: dict[int, list[float]] = {v: [0.0, 0.0] for v in (-1, 0, 1)}
            for p, (votes, n) in zip(post, table):
                seen[votes[k]][0] += p * n
                seen[votes[k]][1] += (1 - p) * n
            sums = [sum(x[i] for x in seen.values()) for i in (0, 1)]
            # a labeler counts as better than chance until votes say otherwise
            hope = {-1: (0.1, 1.0), 0: (0.5, 0.5), 1: (1.0, 0.4)}
            probs.append({v: tuple((seen[v][i] + 4 * hope[v][i]) / (sums[i] + 4 * sum(h[i] for h in hope.values())) for i in (0, 1)) for v in seen})
        post = []
        for votes, _ in table:
            odds = math.log(share / (1 - share)) + sum(math.log(probs[k][v][0] / probs[k][v][1]) for k, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
    return share, probs, post


def trained(found: DataFrame) -> Model:
    """The span classifier for a corpus' candidates. The driver gets counts of vote patterns alone."""
    names = [*VOTES, *SHAPES]
    counted = found.select(F.inline("spans")).groupBy("rank", "base", *names).count().collect()
    return fitted([(KINDS[r["rank"]], r["base"], tuple(r[n] for n in names), r["count"]) for r in counted])


def fitted(counted: list[tuple[str, bool, tuple[int, ...], int]]) -> Model:
    """From counts of (kind, base, votes and shape)."""
    names = [*VOTES, *SHAPES]
    start, weight = {}, {}
    for k in KINDS:
        own = sorted((v, base, n) for kind, base, v, n in counted if kind == k)
        post = reliabilities([(v[: len(VOTES)], n) for v, _, n in own])[2] if own else []
        # the classifier decides on other candidates than base spans, so it begins with the share of true ones among them
        open_to = [(q * n, n) for q, (_, base, n) in zip(post, own) if not base]
        share = (sum(q for q, _ in open_to) + 1) / (sum(n for _, n in open_to) + 2)
        start[k], weight[k] = math.log(share / (1 - share)), {}
        for i, name in enumerate(names):
            # the pattern labeler says the same of all loose candidates, so it says nothing of them
            for value in (-1, 0, 1) if name != "pattern" else ():
                yes = sum(p * n for p, (v, _, n) in zip(post, own) if v[i] == value)
                no = sum((1 - p) * n for p, (v, _, n) in zip(post, own) if v[i] == value)
                all_yes, all_no = (sum(q * n for q, (_, _, n) in zip(side, own)) for side in (post, [1 - p for p in post]))
                hope = (4.0, 2.0) if value > 0 and name in VOTES else (0.4, 4.0) if value < 0 else (2.0, 2.0)
                weight[k][name, value] = math.log((yes + hope[0]) / (all_yes + 6.4)) - math.log((no + hope[1]) / (all_no + 6.4))
    return Model(start, weight)


def with_spans(docs: DataFrame, carry: list[str], text: str = "text", model: Model | None = None) -> DataFrame:
    """row (the carried columns, c0 and so on), and base and added: arrays of (rank, start, end).

    The candidates, with the carried columns, are kept in the shared folder, so that texts are searched once.
    """
    found = Scratch(docs.sparkSession).keep(_candidates(docs, carry, text), "candidates")
    model = model or trained(found)
    place = lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"))

    def accepted(s: Column) -> Column:
        """Candidates that pass the check and that the classifier holds likelier true than not."""
        odds = F.lit(None).cast("double")
        for rank, k in enumerate(KINDS):
            odds = F.when(s["rank"] == rank, model.log_odds(k, {n: s[n] for n in [*VOTES, *SHAPES]})).otherwise(odds)
        return ~s["base"] & (s["check"] > 0) & (odds > 0)

    return found.select("row", F.transform(F.filter("spans", lambda s: s["base"]), place).alias("base"), F.transform(F.filter("spans", accepted), place).alias("added"))


def _carried(carry: list[str]) -> list[Column]:
    return [F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(carry)]


def _kind(s: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind(s), s["start"], s["end"])), ",")


def digest(docs: DataFrame, carry: list[str], text: str = "text", model: Model | None = None) -> DataFrame:
    """Every row's `carry` columns with counts by kind, base_sha256, spans and n_added."""
    found = with_spans(docs, carry, text, model)

    def number(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return found.select(
        *_carried(carry), *[number(k) for k in range(len(KINDS))], F.sha2(_said(F.col("base")), 256).alias("base_sha256"),
        _said(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redacted(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", model: Model | None = None) -> DataFrame:
    """The same columns, with every span replaced by its kind in brackets and n_chars brought up to date.

    Of overlapping spans the first stays and reaches as far as any of them.
    """
    columns = docs.columns
    found = with_spans(docs, columns, text, model)
    own = F.col("row").getField(f"c{columns.index(text)}")
    by_place = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"))))
    spots = found.select("row", by_place.alias("spots"))
    reach = F.zip_with("spots", _scan(F.transform("spots", lambda s: s["end"]), F.greatest), lambda s, before: F.struct(before.alias("before"), s["start"].alias("start"), s["rank"].alias("rank")))
    # the text in chunks, so that a place in it is found without walking from its start
    chunks = F.regexp_extract_all(own, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    heads, last = F.filter(reach, lambda s: s["start"] >= s["before"]), F.array_max(F.transform("spots", lambda s: s["end"]))
    ready = spots.where(F.size("spots") > 0).select("row", heads.alias("heads"), last.alias("last"), chunks.alias("chunks"))

    def part(a: Column, b: Column) -> Column:
        """The text from one place to another."""
        first = F.floor(a / CHUNK).cast("int")
        held = F.slice("chunks", first + 1, F.floor(b / CHUNK).cast("int") - first + 1)
        return F.substring(F.array_join(held, ""), (a % CHUNK + 1).cast("int"), (b - a).cast("int"))

    named = F.transform("heads", lambda s: F.concat(part(s["before"], s["start"]), F.lit("["), F.upper(_kind(s)), F.lit("]")))
    changed = ready.select("row", F.concat(F.array_join(named, ""), part(F.col("last"), F.size("chunks").cast("long") * CHUNK)).alias("new"))
    done = spots.where(F.size("spots") <= 0).select("row", own.alias("new")).unionByName(changed)
    kinds = {f.name: f.dataType for f in docs.schema}
    change = {text: F.col("new").cast(kinds[text]), n_chars: F.length("new").cast(kinds[n_chars]) if n_chars in kinds else None}
    return done.select(*[change[c].alias(c) if c in change else F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(columns)])
