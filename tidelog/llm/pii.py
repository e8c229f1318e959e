"""Personal data by weak supervision, in DataFrame functions only.

Candidates are all matches of the base patterns (valid or not) and of looser ones. Four labelers vote on each: the kind's
own rule, a gazetteer, the words before it, and its borders. Votes and features are counted over the whole corpus (a bounded
number of codes); expectation-maximisation over the counted votes estimates each labeler's reliability for each class, of the
votes that it doesn't abstain from, and a soft label for each code; a logistic classifier over features of the span itself
(its form and checksum, what stands right before it) is trained on the soft labels. It decides on the candidates that aren't base spans; base spans always
stay. Both fits are higher-order functions over one array for each kind.

Base spans, leftmost and non-overlapping for each kind: email, ip (parts to 255), card (14 to 19 digits, Luhn), phone (10 to
15 digits). Offsets are code points, the end exclusive. Null counts as empty; equal rows give equal results; extra columns
stay. With no candidates of a kind, nothing is added for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import private, quoted

KINDS = ["email", "ip", "card", "phone"]
#: The contract's patterns; possessive, and anchored to where a run begins, so that matching takes linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[A-Za-z0-9-]+)++"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Gazetteers (fixed values).
TOP_LEVEL = r"(?i)(?:com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|pl|jp|cn|in|br|mx|au)$"
PRIVATE_IP = r"^0*(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|65|62)"
CALLING = r"^\+(?:1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = [r"mail|contact|write|reach|correo|courriel", r"\bip\b|address|server|host|login|adresse", r"card|visa|credit|payment|tarjeta|carte|karte", r"call|phone|\btel|mobile|\bfax|llam|anruf"]
AGAINST = r"version|isbn|order|invoice|serial|chapter|\bsection|\bno\.\s*$|\bid\b"

CONTEXT = 40
VALUES, LABELERS, FEATURES = 3, 4, 6


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of all matches; places follow from the lengths of matches and of what lies between."""

    def placed(x):
        step = lambda a, m: F.struct((a["i"] + 1).alias("i"), (a["at"] + F.length(x["between"][a["i"]]) + F.length(m)).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["between"][a["i"]])).alias("s"), (a["at"] + F.length(x["between"][a["i"]]) + F.length(m)).alias("e"), m.alias("m")))).alias("out"))
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)").alias("out"))
        return F.aggregate(x["found"], start, step, lambda a: a["out"])

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")), placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: int, m: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return m.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == 2:
        return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    return F.length(_digits(m)).between(10, 15)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """2 for, 0 against, 1 abstains; without `no`, what isn't for is against."""
    return F.when(yes, 2).when(F.lit(True) if no is None else no, 0).otherwise(1)


def _votes(kind: int, text: Column, c: Column, loose: bool) -> tuple[list[Column], list[Column]]:
    m, before = c["m"], F.lower(F.substring(text, F.greatest(c["s"] - CONTEXT, F.lit(0)) + 1, F.least(c["s"], F.lit(CONTEXT))))
    around = F.concat(F.substring(text, c["s"], F.when(c["s"] > 0, 1).otherwise(0)), F.lit(" "), F.substring(text, c["e"] + 1, F.lit(1)))
    rule = F.lit(1) if loose else _vote(_valid(kind, m))
    listed = [_vote(m.rlike(TOP_LEVEL)), _vote(~m.rlike(PRIVATE_IP)), _vote(_digits(m).rlike(ISSUERS)), F.lit(1) if loose else _vote(m.rlike(CALLING))][kind]
    cue = _vote(before.rlike(CUES[kind]), before.rlike(AGAINST))
    border = _vote(~around.rlike(r"[\p{L}\p{N}_@/=]"))
    votes = [rule, listed, cue, border]
    marks = F.length(F.regexp_replace(m, r"[^\x20().-]", ""))
    bits = [F.lit(loose), _valid(kind, m), F.length(_digits(m)) >= 10, marks >= 2, m.rlike(r"^[+(]"), before.rlike(r"[:=]\x20?$")]
    return votes, bits


def _described(kind: int, text: Column, found: Column, loose: bool) -> Column:
    def one(c):
        votes, bits = _votes(kind, text, c, loose)
        code = sum((v * VALUES**i for i, v in enumerate(votes)), F.lit(0))
        feats = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
        base = F.lit(False) if loose else _valid(kind, c["m"])
        return F.struct(F.lit(kind).alias("k"), c["s"].alias("s"), c["e"].alias("e"), base.alias("base"), code.cast("int").alias("votes"), feats.cast("int").alias("feats"))

    return F.transform(found, one)


_EMPTY = "cast(array() as array<struct<k:int,s:int,e:int,base:boolean,votes:int,feats:int>>)"


def candidates(text: Column) -> Column:
    """array<struct<k, s, e, base, votes, feats>>; texts that can't match a pattern aren't searched for it."""
    number = text.rlike("[0-9]")
    kinds = [(0, EMAIL, False, F.contains(text, F.lit("@"))), (1, IP, False, text.rlike(r"[0-9]\.[0-9]")), (2, CARD, False, text.rlike(r"[0-9](?:[\x20-]?[0-9]){9}")), (3, PHONE, False, text.rlike(r"\+[0-9]")), (0, LOOSE_EMAIL, True, text.rlike(r"[\[({]at[\])}]")), (3, LOOSE_PHONE, True, number & text.rlike(r"[0-9][\x20.-][0-9]{4}"))]
    parts = [F.when(may, _described(k, text, matches(text, p), loose)).otherwise(F.expr(_EMPTY)) for k, p, loose, may in kinds]
    sure = lambda x: F.filter(x, lambda c: c["base"])
    overlaps = lambda c, b: (c["s"] < b["e"]) & (b["s"] < c["e"])
    return let(F.concat(*parts), lambda x: F.concat(sure(x), F.filter(x, lambda c: ~c["base"] & ~F.exists(sure(x), lambda b: overlaps(c, b)))))


def _posterior(p: Column, q: Column) -> Column:
    """One round of expectation-maximisation: soft labels of the counted codes p from soft labels q."""
    labels = F.zip_with(p, q, lambda x, w: F.struct(x["votes"].alias("votes"), (x["n"] * w).alias("yes"), (x["n"] * (1 - w)).alias("no")))

    def rates(x):
        mass = lambda name: F.aggregate(x, F.lit(0.0), lambda a, y: a + y[name])
        # by labeler and vote: a third of a labeler's places are abstentions, which are no evidence
        cell = lambda name, i: F.aggregate(x, F.lit(0.5), lambda a, y: a + F.when(F.floor(y["votes"] / F.pow(F.lit(float(VALUES)), F.floor(i / VALUES))) % VALUES == i % VALUES, y[name]).otherwise(0.0))
        cells = F.transform(F.sequence(F.lit(0), F.lit(LABELERS * VALUES - 1)), lambda i: F.struct(cell("yes", i).alias("yes"), cell("no", i).alias("no")))

        def table(t):
            share = lambda c, i, name: c[i][name] / (c[i - i % VALUES][name] + c[i - i % VALUES + 2][name])
            lift = lambda c: F.transform(F.sequence(F.lit(0), F.lit(LABELERS * VALUES - 1)), lambda i: F.when(i % VALUES == 1, 0.0).otherwise(F.log(share(c, i, "yes")) - F.log(share(c, i, "no"))))
            prior = F.log((t["yes"] + 1.0) / (t["no"] + 1.0))

            def label(r):
                odds = lambda y: sum((r["lift"][(F.floor(y["votes"] / VALUES**j) % VALUES + j * VALUES).cast("int")] for j in range(LABELERS)), r["prior"])
                return F.transform(p, lambda y: 1 / (1 + F.exp(-odds(y))))

            return let(F.struct(let(t["cells"], lift).alias("lift"), prior.alias("prior")), label)

        return let(F.struct(mass("yes").alias("yes"), mass("no").alias("no"), cells.alias("cells")), table)

    return let(labels, rates)


def soft_labels(p: Column, rounds: int = 15) -> Column:
    """array<double> beside the codes; starts from the share of votes for."""
    share = lambda x: sum((F.floor(x["votes"] / VALUES**j) % VALUES for j in range(LABELERS)), F.lit(0.0)) / (LABELERS * (VALUES - 1))
    first = F.transform(p, lambda x: F.least(F.greatest(share(x), F.lit(0.05)), F.lit(0.95)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda q, _: _posterior(p, q))


def _bit(feats: Column, i) -> Column:
    return (F.floor(feats / F.pow(F.lit(2.0), i)) % 2).cast("double")


def _margin(w: Column, feats: Column) -> Column:
    return sum((w[i] * _bit(feats, F.lit(i)) for i in range(FEATURES)), w[FEATURES])


def classifier(p: Column, q: Column, steps: int = 80, rate: float = 2.0) -> Column:
    """Weights of the features and the bias, by gradient steps on the soft labels."""
    n = F.aggregate(p, F.lit(1.0), lambda a, x: a + x["n"])

    def step(w, _):
        errors = F.zip_with(p, q, lambda x, y: F.struct(x["feats"].alias("feats"), (x["n"] * (y - 1 / (1 + F.exp(-_margin(w, x["feats"]))))).alias("r")))
        pull = lambda e, i: F.aggregate(e, F.lit(0.0), lambda a, x: a + F.when(i == FEATURES, x["r"]).otherwise(x["r"] * _bit(x["feats"], i)))
        return let(errors, lambda e: F.transform(F.sequence(F.lit(0), F.lit(FEATURES)), lambda i: F.element_at(w, i + 1) * 0.999 + rate * pull(e, i) / n))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array_repeat(F.lit(0.0), FEATURES + 1), step)


def with_candidates(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    return docs.withColumn(name, candidates(F.coalesce(quoted(text_col), F.lit(""))))


def fit(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k, labelled: the counted codes with their soft labels, weights, accept: the decision by feature code), at most a
    row for each kind."""
    found = with_candidates(docs.select(quoted(text_col).alias("text")), "text", "found")
    counts = found.select(F.explode("found").alias("c")).groupBy("c.k", "c.votes", "c.feats").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # at most VALUES^LABELERS * 2^FEATURES codes of a kind
    by_kind = counts.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("votes", "feats", "n"))).alias("p"))
    fitted = by_kind.withColumn("q", soft_labels(F.col("p"))).withColumn("weights", classifier(F.col("p"), F.col("q")))
    accept = F.transform(F.sequence(F.lit(0), F.lit(2**FEATURES - 1)), lambda f: _margin(F.col("weights"), f) > 0)
    return fitted.select("k", F.arrays_zip("p", "q").alias("labelled"), "weights", accept.alias("accept"))


def spans(docs: DataFrame, text_col: str = "text", name: str = "spans") -> DataFrame:
    """docs with array<struct<s, k, e, base>> under that name, by start, then kind."""
    accept = {r["k"]: r["accept"] for r in fit(docs, text_col).select("k", "accept").collect()}  # 4 x 64 booleans
    table = F.lit([bool(x) for k in range(len(KINDS)) for x in accept.get(k, [False] * 2**FEATURES)])
    (found,) = private([*docs.columns, name], "found")
    kept = F.filter(found, lambda c: c["base"] | table[c["k"] * 2**FEATURES + c["feats"]])
    ordered = F.array_sort(F.transform(kept, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["base"].alias("base"))))
    return with_candidates(docs, text_col, found).withColumn(name, ordered).drop(found)


def listed(found: Column) -> Column:
    names = F.lit(KINDS)
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", names[c["k"]], c["s"].cast("string"), c["e"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    base = F.filter("spans", lambda c: c["base"])
    of_kind = lambda k: F.size(F.filter("spans", lambda c: c["base"] & (c["k"] == k)))
    counts = [of_kind(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    rows = spans(docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text")))
    return rows.select("doc_id", *counts, F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by [EMAIL], [IP], [CARD] or [PHONE]; overlapping spans become one."""
    (found,) = private(docs.columns, "spans")
    text, names = quoted(text_col), F.lit([f"[{k.upper()}]" for k in KINDS])

    def step(a, c):
        fresh = c["s"] >= a["at"]
        more = F.array(F.substring(text, a["at"] + 1, c["s"] - a["at"]), names[c["k"]])
        return F.struct(F.greatest(a["at"], c["e"]).alias("at"), F.when(fresh, F.concat(a["out"], more)).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    whole = F.aggregate(found, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return spans(docs, text_col, found).withColumn(text_col, F.when(text.isNull() | (F.size(found) == 0), text).otherwise(whole)).drop(found)
