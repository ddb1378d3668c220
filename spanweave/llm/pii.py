"""Personal data by weak supervision, in DataFrame expressions only.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers; these spans always
stay. Looser patterns propose more candidates of the same kinds. Three labelers vote on every
candidate (for, against, none): a regular-expression check of its form, a gazetteer (domains, network
ranges, card issuers, country codes), and the words in front of it. Expectation-maximisation over the
counted vote patterns (at most 27 a kind) estimates what each vote of each labeler is worth; a
naive Bayes classifier is trained on the resulting posteriors over features of the span that no
labeler votes on, and adds the proposed spans that it and the votes together find more likely personal than not.

Counts and weights come from all candidates of all texts: one map-side combined aggregate of a fixed
alphabet (kind, votes, features). Texts are never shuffled; they are read once for the counts and once for
the spans. Offsets are code points; base patterns are written so that each text is scanned in linear
time (possessive runs that start only where a run starts).

Defined results: null and empty texts have no spans; repeated rows are judged alike; without candidates
nothing is added; an empty table gives an empty table; other columns are kept (the result comes in one column
``__spans`` that replaces one of that name).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.session import materialize

KINDS = ("email", "ip", "card", "phone")
CANDIDATE = "struct<kind: int, start: int, end: int, base: boolean, votes: string, features: array<string>>"

# fixed values: the base patterns in linear-time form
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"
# looser forms: spelled-out addresses, IPv6, and national numbers
LOOSE_EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+"
    r"(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63}+){1,5}"
)
LOOSE_IP = r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])"
LOOSE_PHONE = r"(?<![0-9+.-])(?<![0-9+] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
# what a text must hold for a pattern to match; most texts are settled by this one short scan
EMAIL_SIGN, IP_SIGN, CARD_SIGN, PHONE_SIGN = "@", r"[0-9]\.[0-9]", r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", r"\+[0-9]"
LOOSE_EMAIL_SIGN, LOOSE_IP_SIGN, LOOSE_PHONE_SIGN = r"at[\])]", ":[0-9A-Fa-f]{1,4}:", "[0-9]{3}[ .-][0-9]{4}"
# gazetteers
DOMAINS = r"(?i)(?:\.|dot\)|dot\]) ?(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|ch|at|us|ca|nl|be|pl|pt|br|mx)$"
NETWORKS = r"^(?:0|127|255)\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6011|64[4-9]|65|62)"
COUNTRIES = r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
CUES = r"(?i)mail|contact|write to|phone|tel|call|fax|mobil|card|visa|pay|server|host|addr|\bip\b|kontakt|karte|correo|carte"
COUNTER_CUES = r"(?i)version|release|order|invoice|isbn|sku|token|ref|build|serial|\bv$|\bno\.? ?$|\bid"
NEAR = 32


INTS = "cast(array() as array<int>)"
SHORTEST, CHUNK = 4, 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running sums or maxima of an array of n numbers, in blocks of about the root of n: arrays are copied
    when they grow, so a single fold would take time in proportion to the square of n."""
    def one(part: Column) -> Column:
        grow = lambda s, x: F.concat(s, F.array(F.when(F.size(s) == 0, x).otherwise(step(F.get(s, F.size(s) - 1), x))))
        return F.aggregate(part, F.expr(INTS), grow)

    def joined(blocks: Column) -> Column:
        lasts = one(F.transform(blocks, lambda r: F.get(r, F.size(r) - 1)))
        shift = lambda before: lambda r, i: F.transform(r, lambda x: F.when(i == 0, x).otherwise(step(F.get(before, i - 1), x)))
        return _let(lasts, lambda before: F.flatten(F.transform(blocks, shift(before))))

    def whole(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"), F.lit(8))
        cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda b: one(F.slice(v, b * w + 1, w)))
        return F.when(F.size(v) == 0, F.expr(INTS)).otherwise(_let(width, lambda w: _let(cut(w), joined)))

    return _let(values, whole)


def _found(text: Column, pattern: str, sign: str) -> Column:
    """(start, end, match, before) of every match; positions add up what lies between the matches, and the text
    before a match is put together from the last gaps and matches, each of which has ``SHORTEST`` characters at least."""
    def listed(matches: Column, gaps: Column, ends: Column, pieces: Column) -> Column:
        back = -(-NEAR // SHORTEST)

        def one(m: Column, i: Column) -> Column:
            earlier = F.array_join(F.slice(pieces, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back))), "")
            before = F.substring(F.concat(earlier, F.get(gaps, i)), -NEAR, NEAR)
            return F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"), before.alias("before"))

        return F.transform(matches, one)

    def placed(matches: Column, gaps: Column) -> Column:
        ends = _running(F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)), lambda a, b: a + b)
        pieces = F.transform(matches, lambda m, i: F.concat(F.get(gaps, i), m))
        return _let(ends, lambda e: _let(pieces, lambda p: listed(matches, gaps, e, p)))

    none = F.expr("cast(array() as array<struct<start: int, end: int, match: string, before: string>>)")
    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: _let(F.split(text, pattern, -1), lambda g: placed(m, g)))
    return F.when(text.rlike(sign), found).otherwise(none)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def worth(at: Column) -> Column:
        digit = F.substring(digits, -at, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(at % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda s, at: s + F.coalesce(worth(at), F.lit(0)))
    return total % 10 == 0


def _valid(kind: int, match: Column) -> Column:
    if KINDS[kind] == "ip":
        return match.rlike(OCTETS)
    if KINDS[kind] == "card":
        return luhn(_digits(match))
    if KINDS[kind] == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "+").when(no, "-").otherwise("0")


def _candidate(kind: int, loose: bool, found: Column) -> Column:
    match, digits, before = found["match"], _digits(found["match"]), found["before"]
    valid = F.lit(False) if loose else _valid(kind, match)
    never = F.lit(False)
    form = _vote(valid, never if loose else ~valid)
    gazetteer = {
        "email": _vote(match.rlike(DOMAINS), ~match.rlike(DOMAINS)),
        "ip": _vote(~match.rlike(NETWORKS), match.rlike(NETWORKS)) if not loose else F.lit("0"),
        "card": _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
        "phone": _vote(match.rlike(COUNTRIES), match.startswith("+") & ~match.rlike(COUNTRIES)),
    }[KINDS[kind]]
    context = _vote(before.rlike(CUES), before.rlike(COUNTER_CUES))
    features = F.array(
        F.concat(F.lit("length:"), F.least(F.length(match) / 4, F.lit(8)).cast("int").cast("string")),
        F.concat(F.lit("digits:"), F.least(F.length(digits) / 3, F.lit(7)).cast("int").cast("string")),
        F.concat(F.lit("spelled:"), F.when(F.lit(loose), "1").otherwise("0")),
        F.concat(F.lit("before:"), F.when(before.rlike(r"[ \n\t]$"), "space").when(before.rlike("[A-Za-z0-9]$"), "word").when(before == "", "start").otherwise("sign")),
        F.concat(F.lit("parts:"), F.least(F.size(F.split(match, "[^A-Za-z0-9]+")), F.lit(7)).cast("string")),
    )
    return F.struct(
        F.lit(kind).alias("kind"), found["start"].alias("start"), found["end"].alias("end"), valid.alias("base"),
        F.concat(form, gazetteer, context).alias("votes"), features.alias("features"),
    )


def candidates(text: Column) -> Column:
    """Array of all candidates of a text."""
    patterns = [
        (0, False, EMAIL, EMAIL_SIGN), (1, False, IP, IP_SIGN), (2, False, CARD, CARD_SIGN), (3, False, PHONE, PHONE_SIGN),
        (0, True, LOOSE_EMAIL, LOOSE_EMAIL_SIGN), (1, True, LOOSE_IP, LOOSE_IP_SIGN), (3, True, LOOSE_PHONE, LOOSE_PHONE_SIGN),
    ]
    text = F.coalesce(text, F.lit(""))

    def part(kind: int, loose: bool, pattern: str, sign: str) -> Column:
        return F.transform(_found(text, pattern, sign), lambda x: _candidate(kind, loose, x))

    return F.concat(*[part(*p) for p in patterns])


def vote_worth(counts: DataFrame, rounds: int = 30) -> DataFrame:
    """(kind, votes, chance): the posterior of each vote pattern by expectation-maximisation.

    ``counts`` has kind, votes and n. How often each labeler votes for a span, if it votes, is estimated
    for spans that are personal and for those that are not, ``rounds`` times in one fold (no vote says
    nothing); a kind is one row with at most 27 patterns."""
    grouped = counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    # t: share of votes for, by labeler, of spans that are not personal (0 to 2) and that are (3 to 5); share of those (6)
    start = "array(0.3D, 0.3D, 0.3D, 0.8D, 0.8D, 0.8D, 0.5D)"
    logit = "ln(get(t, 6) / (1 - get(t, 6)))" + "".join(
        f" + CASE substring(p.votes, {l + 1}, 1) WHEN '+' THEN ln(get(t, {l + 3}) / get(t, {l}))"
        f" WHEN '-' THEN ln((1 - get(t, {l + 3})) / (1 - get(t, {l}))) ELSE 0D END" for l in range(3)
    )
    chance = f"1 / (1 + exp(-({logit})))"
    weighed = f"transform(patterns, p -> struct(p.votes AS votes, p.n * ({chance}) AS one, p.n * (1 - ({chance})) AS zero))"

    def total(part: str, where: str = "true") -> str:
        return f"aggregate(filter(w, p -> {where}), 0D, (s, p) -> s + p.{part})"

    # two pseudo-counts hold each share near its start
    shares = [
        f"({total(part, f"substring(p.votes, {l + 1}, 1) = '+'")} + 2 * get({start}, {at + l}))"
        f" / ({total(part, f"substring(p.votes, {l + 1}, 1) != '0'")} + 2)"
        for part, at in (("zero", 0), ("one", 3)) for l in range(3)
    ]
    prior = f"({total('one')} + 1) / ({total('one')} + {total('zero')} + 2)"
    update = f"get(transform(array({weighed}), w -> array({', '.join([*shares, prior])})), 0)"
    fitted = grouped.withColumn("t", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (t, r) -> {update})"))
    return fitted.select("kind", F.expr(f"inline(transform(patterns, p -> struct(p.votes AS votes, {chance} AS chance)))"))


def train(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Log-odds of votes ("kind|votes"), features ("kind|feature") and kinds: some hundred numbers."""
    listed = docs.select(F.explode(candidates(F.col(text_col).cast("string"))).alias("c")).select("c.kind", "c.votes", "c.features")
    counts = listed.groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    counts = materialize(counts, "candidates")
    worth = vote_worth(counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")))
    each = counts.join(worth, ["kind", "votes"]).select(
        "kind", F.explode("features").alias("feature"), (F.col("n") * F.col("chance")).alias("one"),
        (F.col("n") * (1 - F.col("chance"))).alias("zero"),
    )
    sums = each.groupBy("kind", "feature").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    whole = counts.join(worth, ["kind", "votes"]).groupBy("kind").agg(
        F.sum(F.col("n") * F.col("chance")).alias("all_one"), F.sum(F.col("n") * (1 - F.col("chance"))).alias("all_zero")
    )
    # chances of a feature in either class, with two pseudo-counts spread as over all candidates
    share = (F.col("one") + F.col("zero")) / (F.col("all_one") + F.col("all_zero"))
    features = sums.join(whole, "kind").select(
        F.concat_ws("|", "kind", "feature").alias("name"),
        F.log(
            (F.col("one") + 2 * share) / (F.col("all_one") + 2) / ((F.col("zero") + 2 * share) / (F.col("all_zero") + 2))
        ).alias("weight"),
    )
    votes = worth.select(F.concat_ws("|", "kind", "votes").alias("name"), F.log(F.col("chance") / (1 - F.col("chance"))).alias("weight"))
    return {r["name"]: r["weight"] for r in features.unionAll(votes).orderBy("name").collect()}


def spans(docs: DataFrame, weights: dict[str, float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``__spans``: (kind number, start, end, base) by kind and start; base spans and those the model adds."""
    table = F.create_map(*[F.lit(x) for pair in (weights or {"": 0.0}).items() for x in pair])

    def weight(kind: Column, name: Column) -> Column:
        return F.coalesce(F.element_at(table, F.concat_ws("|", kind.cast("string"), name)), F.lit(0.0))

    def likely(c: Column) -> Column:
        return weight(c["kind"], c["votes"]) + F.aggregate(c["features"], F.lit(0.0), lambda s, f: s + weight(c["kind"], f)) > 0

    listed = docs.drop("__spans").withColumn("__spans", candidates(F.col(text_col).cast("string")))
    base = F.filter("__spans", lambda c: c["base"])
    proposed = F.filter("__spans", lambda c: ~c["base"] & (F.substring(c["votes"], 1, 1) != "-"))
    listed = listed.withColumn("__spans", F.struct(base.alias("base"), proposed.alias("proposed")))

    def blocks(b: Column) -> Column:
        """The base spans in blocks, with the range of each, so that a proposal looks into few of them."""
        width = F.greatest(F.ceil(F.sqrt(F.size(b).cast("double"))).cast("int"), F.lit(8))
        each = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / w).cast("int")), lambda i: F.slice(b, i * w + 1, w))
        ranged = lambda part: F.struct(
            F.array_min(F.transform(part, lambda c: c["start"])).alias("low"), F.array_max(F.transform(part, lambda c: c["end"])).alias("high"), part.alias("spans")
        )
        return F.transform(_let(width, each), ranged)

    def meets(a: Column, start: Column, end: Column) -> Column:
        return (start < a["end"]) & (a["start"] < end)

    def free(c: Column, of: Column) -> Column:
        return ~F.exists(of, lambda p: meets(c, p["low"], p["high"]) & F.exists(p["spans"], lambda b: (b["kind"] == c["kind"]) & meets(c, b["start"], b["end"])))

    some = F.col("__spans.base")
    clear = _let(some, lambda b: _let(blocks(b), lambda of: F.filter("__spans.proposed", lambda c: free(c, of) & likely(c))))
    added = F.when(F.size(some) == 0, F.filter("__spans.proposed", likely)).otherwise(clear)
    kept = F.transform(F.concat("__spans.base", added), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))
    return listed.withColumn("__spans", F.array_sort(kept))


def span_text(spans_: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans_, lambda c: F.concat_ws(
        ":", F.element_at(names, c["kind"] + 1), c["start"].cast("string"), c["end"].cast("string")
    )))


def redact(text: Column, spans_: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the place."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans_, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))

    def between(chunks: Column, start: Column, end: Column) -> Column:
        """A part of the text, from the chunks that hold it: finding a place in a string takes time in proportion to the place."""
        first = F.floor(start / CHUNK).cast("int")
        held = F.array_join(F.slice(chunks, first + 1, F.floor(end / CHUNK).cast("int") - first + 1), "")
        return F.substring(held, start - first * CHUNK + 1, end - start)

    def put(chunks: Column, c: Column, reach: Column) -> Column:
        # reach[i] is how far the spans up to i go; a span behind all earlier ones names a place
        def piece(x: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
            named = F.concat(between(chunks, before, x["start"]), F.element_at(names, x["kind"] + 1))
            return F.when(x["start"] >= before, named).otherwise("")

        rest = between(chunks, F.get(reach, F.size(reach) - 1), F.length(text))
        return F.array_join(F.concat(F.transform(c, piece), F.array(rest)), "")

    def redacted(c: Column) -> Column:
        reach = _running(F.transform(c, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        return _let(reach, lambda r: _let(chunks, lambda t: put(t, c, r)))

    return F.when(F.size(spans_) > 0, _let(ordered, redacted)).otherwise(text)
