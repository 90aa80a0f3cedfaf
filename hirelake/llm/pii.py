"""Personal data spans by weak supervision, with DataFrame functions alone.

Candidates come from the base patterns and from looser ones, which also reach what no base pattern has:
obfuscated addresses, numbers in other shapes, secrets. Four labelers vote on each candidate: the regex
of its shape, a check of its value, a gazetteer, and the words before it. Expectation-maximisation over
the counted votes estimates how reliable each labeler is for each kind, without any label. A logistic
classifier is then trained on the resulting probabilities. It sees the span itself (length, share of
digits, separators, what stands before it) and none of the votes, and it decides on all candidates that
aren't base spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import Cut, spare_name

#: Kinds with a base pattern, and all kinds, in the order of the spans.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Base patterns. Possessive repeats and the guard before a run keep long runs linear without changing
#: a match: a match can start inside a run only where the one before it ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns, whose matches only the classifier can accept.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[] ?(?:at|AT) ?[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[] ?(?:dot|DOT) ?[)\]]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+=*+",
}
#: What a text must have for a pattern to match anywhere in it.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike("[0-9]"),
    "phone": lambda t: t.contains("+"),
}
LOOSE_NEEDS = {
    "email": lambda t: t.rlike(r"[(\[] ?(?:at|AT) ?[)\]]"),
    "ip": lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]"),
    "card": lambda t: t.rlike(r"[0-9]{4}\.[0-9]{4}\."),
    "phone": lambda t: t.rlike(r"[0-9]{3}[.-][0-9]{4}"),
    "secret": lambda t: t.rlike(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20}"),
}
#: Gazetteers: domain endings, address blocks that belong to no host, card issuers, calling codes, key prefixes.
ENDINGS = "com org net edu gov mil int info biz name pro io co me tv app dev ai at au be bg br ca ch cl cn cz de dk ee es eu fi fr gr hk hr hu id ie il in is it jp kr lt lu lv ma mx my nl no nz pe ph pl pt ro rs ru se sg si sk th tr tw ua uk us vn za".split()
NO_HOST = r"^(?:0|255|127|2[34][0-9]|25[0-5])\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6(?:011|[45]))"
CALLING = r"^(?:1|7|2[07]|2[1-6][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[013]|5[1-8]|50[0-9]|59[0-9]|6[0-6]|6[7-9][0-9]|8[1246]|85[0-9]|88[06]|9[0-58]|9[679][0-9])"
KEYS = r"^(?:AKIA|ASIA|gh[oprsu]_|github_pat_|glpat-|npm_|sk[-_]|pk[-_]|xox[abprs]-|AIza|eyJ)"
#: Words before a span that speak for its kind, and words that speak against any.
SPEAKS = {
    "email": r"mail|contact|write|reach",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|credit|payment|paid",
    "phone": r"phone|call|tel|mobile|fax|dial",
    "secret": r"(?:token|secret|passw(?:or)?d|passphrase|api.?key|access.?key|private.?key|credential|auth|bearer)[^a-z]{0,8}$",
}
AGAINST = r"version|\bv\.?$|order|isbn|sku|build|serial|section|figure|commit|checksum|sha-?[0-9]+\W*$|md5"
#: The labelers, by their place in ``votes``: +1 for, -1 against, 0 no opinion.
VOTERS = ("shape", "value", "gazetteer", "context")
BEFORE, ROUNDS, ACCEPT, BLOCK = 24, 12, 0.9, 64
_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,traits:array<string>>>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """The running fold of an array of ints, by blocks, so that no step copies what came before it."""

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), combine))
        inside = lambda b, head: F.transform(b, lambda _, i: F.aggregate(F.slice(b, 1, i + 1), head, combine))
        placed = lambda ts: F.transform(blocks, lambda b, k: bind(F.aggregate(F.slice(ts, 1, k), F.lit(zero), combine), lambda head: inside(b, head)))
        return F.flatten(bind(totals, placed))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))
    return F.when(F.size(values) > 0, bind(blocks, over)).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, pattern: str) -> Column:
    """The pattern's matches with their ends in code points and what stands before them, in lower case.

    The gaps that split() leaves alternate with the matches; running sums of both give the places. What
    stands before reaches back to the match before at most.
    """
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.lower(F.right(gap, F.lit(BEFORE))).alias("before"), m.alias("value")))
    real = F.filter(pieces, lambda p: p["value"].isNotNull())
    ends = lambda ps: running(F.transform(ps, lambda p: p["gap"] + F.length(p["value"])), lambda x, y: x + y, 0)
    return bind(real, lambda ps: bind(ends(ps), lambda es: F.zip_with(ps, es, lambda p, e: F.struct(p["value"].alias("value"), p["before"].alias("before"), e.alias("end")))))


def _valid(kind: str, value: Column, digits: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def _span(kind: str, loose: bool, found: Column, digits: Column) -> Column:
    """The candidate span of one match, with the labelers' votes and the traits that the classifier sees."""
    value, before = found["value"], found["before"]
    no = F.lit(False)
    valid = _valid(kind, value, digits) if not (kind == "ip" and loose) else F.lit(True)
    shape, bad_shape = (no, no) if loose else (F.lit(True), no)
    checked, unchecked = valid, ~valid
    listed, unlisted = no, no
    if kind == "email":
        listed = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1)).isin(*ENDINGS)
        unlisted = ~listed
    elif kind == "ip":
        unlisted = value.rlike(NO_HOST)
    elif kind == "card":
        listed = digits.rlike(ISSUERS)
        unlisted = ~listed
    elif kind == "phone":
        listed = no if loose else digits.rlike(CALLING)
        unlisted = digits.rlike("^0") if loose else ~digits.rlike(CALLING)
    else:
        mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        shape, bad_shape = value.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | (mixed & value.rlike("[a-z]") & value.rlike("[A-Z]")), ~mixed
        # Random characters repeat little and mix digits in; words and numbers don't.
        share = F.length(digits) / F.length(value)
        checked, unchecked = (share > 0.1) & (share < 0.95), (share <= 0.02) | (share >= 0.98)
        listed = value.rlike(KEYS)
    base = F.lit(False) if loose else valid
    others = F.length(F.regexp_replace(value, "[A-Za-z0-9]", ""))
    traits = {
        "length": F.least(F.floor(F.log2(F.length(value))), F.lit(9)).cast("string"),
        "digits": F.floor(4 * F.length(digits) / F.length(value)).cast("string"),
        "separators": F.least(others, F.lit(4)).cast("string"),
        "upper": F.least(F.length(F.regexp_replace(value, "[^A-Z]", "")), F.lit(2)).cast("string"),
        "assigned": before.rlike(r"[=:]\s*[\"'`]?$").cast("string"),
        "word": before.rlike(SPEAKS[kind]).cast("string"),
    }
    names = [F.lit(kind), *(F.concat(F.lit(f"{kind}.{name}="), v) for name, v in traits.items())]
    votes = F.array(_vote(shape, bad_shape), _vote(checked, unchecked), _vote(listed, unlisted), _vote(before.rlike(SPEAKS[kind]), before.rlike(AGAINST)))
    return F.struct(F.lit(kind).alias("kind"), (found["end"] - F.length(value)).alias("start"), found["end"].alias("end"), base.alias("base"), votes.alias("votes"), F.array(*names).alias("traits"))


def _judge(kind: str, loose: bool) -> Callable[[Column], Column]:
    return lambda found: bind(F.regexp_replace(found["value"], "[^0-9]", ""), lambda digits: _span(kind, loose, found, digits))


def candidates(text: Column) -> Column:
    """All candidate spans of a text column; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    found = []
    for patterns, needs, loose in ((BASE, NEEDS, False), (LOOSE, LOOSE_NEEDS, True)):
        for kind, pattern in patterns.items():
            spans = F.transform(_matches(text, pattern), _judge(kind, loose)).cast(_SPANS)
            found.append(F.when(needs[kind](text), spans).otherwise(F.array().cast(_SPANS)))
    return F.concat(*found)


def probability(state: Column, votes: Column) -> Column:
    """The probability that a candidate with these votes is personal data, under a kind's reliabilities."""
    odds = F.log(state["prior"] / (1 - state["prior"]))
    for j in range(len(VOTERS)):
        sens, spec = F.get(state["sens"], F.lit(j)), F.get(state["spec"], F.lit(j))
        vote = F.get(votes, F.lit(j))
        odds = odds + F.when(vote == 1, F.log(sens / (1 - spec))).when(vote == -1, F.log((1 - sens) / spec)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def reliabilities(patterns: DataFrame) -> DataFrame:
    """(kind, state): a kind's prior and each labeler's sensitivity and specificity.

    patterns: kind, votes and n, a row for each combination of votes that occurs (81 a kind at most). All
    rounds of expectation-maximisation are one expression over a kind's row.
    """
    state_type = "struct<prior:double,sens:array<double>,spec:array<double>>"
    start = F.struct(F.lit(0.5).alias("prior"), F.array_repeat(F.lit(0.8), len(VOTERS)).alias("sens"), F.array_repeat(F.lit(0.8), len(VOTERS)).alias("spec")).cast(state_type)

    def maximised(rows: Column) -> Column:
        total = lambda value: F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + value(r))
        on = lambda j, sign, field: total(lambda r: F.when(F.get(r["votes"], F.lit(j)) == sign, r[field]).otherwise(0.0))
        # Five votes' worth of belief that a labeler is right four times of five.
        sens = [(on(j, 1, "yes") + 4) / (on(j, 1, "yes") + on(j, -1, "yes") + 5) for j in range(len(VOTERS))]
        spec = [(on(j, -1, "no") + 4) / (on(j, -1, "no") + on(j, 1, "no") + 5) for j in range(len(VOTERS))]
        prior = (total(lambda r: r["yes"]) + 2) / (total(lambda r: r["yes"] + r["no"]) + 4)
        return F.struct(prior.alias("prior"), F.array(*sens).alias("sens"), F.array(*spec).alias("spec")).cast(state_type)

    def step(state: Column, _: Column) -> Column:
        expected = F.transform("rows", lambda r: bind(probability(state, r["votes"]), lambda p: F.struct(r["votes"].alias("votes"), (r["n"] * p).alias("yes"), (r["n"] * (1 - p)).alias("no"))))
        return bind(expected, maximised)

    rows = patterns.groupBy("kind").agg(F.collect_list(F.struct("votes", "n")).alias("rows"))
    return rows.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("state"))


def train(spans: DataFrame) -> dict[str, float]:
    """The classifier's weights by trait, and its bias under the empty name, from rows of candidate spans."""
    counted = Cut(spans.groupBy("kind", "votes", "traits").agg(F.count("*").cast("double").alias("n")).coalesce(1), "vote-patterns")
    patterns = counted.read()
    if patterns.isEmpty():
        counted.drop()
        return {"": -10.0}
    states = reliabilities(patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n")))
    totals = patterns.groupBy("kind").agg(F.sum("n").alias("total"))
    p, share = F.col("p"), F.col("n") / F.col("total")
    judged = patterns.join(F.broadcast(states), "kind").join(F.broadcast(totals), "kind").withColumn("p", probability(F.col("state"), F.col("votes")))
    # All kinds weigh the same, however often they occur.
    sides = F.array(F.struct(F.lit(1.0).alias("label"), (share * p).alias("weight")), F.struct(F.lit(0.0).alias("label"), (share * (1 - p)).alias("weight")))
    rows = Cut(judged.select("traits", F.explode(sides).alias("y")).select("traits", "y.*").coalesce(1), "training-rows")
    words = CountVectorizer(inputCol="traits", outputCol="features", binary=True).fit(rows.read())
    fitted = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=30, standardization=False).fit(words.transform(rows.read()))
    weights = dict(zip(words.vocabulary, map(float, fitted.coefficients), strict=True)) | {"": float(fitted.intercept)}
    counted.drop()
    rows.drop()
    return weights


def decided(cands: Column, weights: dict[str, float]) -> Column:
    """The spans that stand: base spans, and accepted candidates that overlap no base span, by start."""
    known = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    odds = lambda s: F.aggregate(s["traits"], F.lit(weights[""]), lambda acc, t: acc + F.coalesce(F.try_element_at(known, t), F.lit(0.0)))
    rank = lambda s: F.array_position(F.array(*map(F.lit, ALL_KINDS)), s["kind"]).cast("int")
    likely = F.filter(cands, lambda s: F.when(s["base"], True).otherwise(1 / (1 + F.exp(-odds(s))) >= ACCEPT))
    ordered = F.array_sort(F.transform(likely, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), rank(s).alias("rank"), s["kind"].alias("kind"), s["base"].alias("base"))))

    def clear(spans: Column) -> Column:
        far = 2**31 - 1
        before = running(F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(0)), lambda x, y: F.greatest(x, y), 0)
        after = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s["base"], s["start"]).otherwise(far))), lambda x, y: F.least(x, y), far))
        return bind(before, lambda ends: bind(after, lambda starts: F.filter(spans, lambda s, i: s["base"] | ((F.get(ends, i) <= s["start"]) & (F.get(starts, i) >= s["end"])))))

    return bind(ordered, lambda spans: F.when(F.exists(spans, lambda s: ~s["base"]), clear(spans)).otherwise(spans))


def _joined(spans: Column) -> Column:
    by_kind = F.array_sort(F.transform(spans, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(by_kind, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row of ``docs``.

    Counts by kind and the digest are those of the base spans; ``spans`` lists all, as kind:start:end in
    code points, the end exclusive, and ``n_spans`` counts them. A null text counts as empty, without
    spans. Texts are searched whole. Null ids and repeated rows stay; other columns are ignored; an empty
    table gives an empty result.
    """
    found = Cut(docs.select(F.col(id_col).alias("id"), candidates(F.col(text_col)).alias("cands")), "pii-candidates").read()
    weights = train(found.select(F.explode("cands").alias("s")).select("s.*"))
    spans = found.select("id", decided(F.col("cands"), weights).alias("spans"))
    of_kind = lambda kind: lambda s: s["base"] & (s["kind"] == kind)
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["base"])
    return spans.select(F.col("id").alias(id_col), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span (ordered by start) replaced by its kind in brackets, overlapping ones by the first's.

    The text is cut into stretches of some hundred spans first, and each of those into its pieces.
    """

    def pieces(runs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / (4 * BLOCK)).cast("int"))

        def block(k: Column) -> Column:
            some = F.slice(runs, k * 4 * BLOCK + 1, 4 * BLOCK)
            stretch = lambda rs: F.substring(text, F.get(rs, F.lit(0))["after"] + 1, F.element_at(rs, -1)["start"] - F.get(rs, F.lit(0))["after"])
            piece = lambda rs, part: F.transform(rs, lambda r: F.concat(F.substring(part, r["after"] - F.get(rs, F.lit(0))["after"] + 1, r["start"] - r["after"]), F.lit("["), F.upper(r["kind"]), F.lit("]")))
            return bind(some, lambda rs: bind(stretch(rs), lambda part: F.array_join(piece(rs, part), "")))

        return F.array_join(F.transform(blocks, block), "")

    def with_ends(ends: Column) -> Column:
        # ``after`` is the end of what was replaced before; a span that starts sooner is cut along with that.
        runs = F.filter(F.transform(spans, lambda s, i: F.struct(F.when(i > 0, F.get(ends, i - 1)).otherwise(0).alias("after"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda r: r["start"] >= r["after"])
        return F.concat(bind(runs, pieces), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    return bind(running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y), 0), with_ends)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of text replaced by its kind in brackets; n_chars follows if present.

    Spans that overlap one replaced before are cut along with it. Null texts stay null. All rows stay.
    """
    extra = spare_name(docs, "cands")
    found = Cut(docs.withColumn(extra, candidates(F.col("text"))), "pii-texts").read()
    weights = train(found.select(F.explode(extra).alias("s")).select("s.*"))
    text = F.col("text")
    cleaned = bind(decided(F.col(extra), weights), lambda spans: F.when(F.size(spans) > 0, masked(text, spans)).otherwise(text))
    out = found.withColumn("text", F.when(F.size(extra) > 0, cleaned).otherwise(text)).drop(extra)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
