"""Personal data: strict base patterns, and further spans chosen by gradient boosting over broad candidates.

`base_spans` finds the four strict kinds (email, ip, card, phone) with checked parts, digits and check sums. Generators
with loose patterns then propose spans, which may overlap each other; each gets a few small whole-number features of its
format and context. Boosted trees are fitted on two kinds of examples. Of the given documents all candidates for addresses and
numbers count, with those as positives that overlap a strict span, or are one in another form (an email with [at] or [dot]
spelled out, an IPv6 address of eight groups). The strict patterns say nothing of secrets (`secret`: a name with a value,
`key`: a long run of letters and digits), so their labels come from a seeded table of examples (`planted`): keys, tokens and
passwords in varied forms among hard negatives, such as settings, file names, long words and numbers that fail their check
sum. Spark counts the candidates per feature vector, and since the vectors are few (their number is bounded by the product
of the features' values, whatever the input) the trees are fitted on these counts. Scores are turned into probabilities on
documents and examples held out of the fit, and a candidate is selected from `threshold` on. Base spans always stay.

Text never leaves the JVM. Patterns that could try a long stretch again from each of its characters start only at its
beginning or where the last match ended, and loops are possessive, so very long texts cost linear time and no deep stack.

Defined cases: null is the empty text, without spans; with no documents the model knows secrets alone; an empty table gives no
rows; ties go to the longer, then the earlier span; texts of any length are read whole; repeated rows are kept as they are; other columns are never read, and `redacted` hands them through, whatever their names.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.llm.common import bound, hex_text, prefix_maxima, prefix_sums

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
_LABEL = r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
SPANS = "array<struct<kind:string,start:int,end:int>>"

_AT = r"[(\[{]\x20?(?:at|AT)\x20?[)\]}]"
_DOT = r"[(\[{]\x20?(?:dot|DOT)\x20?[)\]}]"
IPV6 = r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"

# broad generators; the order gives the feature `family`
GENERATORS = {
    "address": r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[(\[{]\x20?(?:at|AT)\x20?[)\]}])\x20?[A-Za-z0-9-]++"
               r"(?:\x20?(?:\.|[(\[{]\x20?(?:dot|DOT)\x20?[)\]}])\x20?[A-Za-z0-9-]++)*+",
    "number": r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "grouped": r"(?<![0-9])[0-9]{2,4}(?:[.\x20-][0-9]{2,4}){2,4}(?![0-9])",
    "network": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,4}(?:\.[0-9]{1,4}){3,5}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})",
    "secret": r"(?<![A-Za-z0-9_.-])[A-Za-z][A-Za-z0-9_.-]{1,40}+[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?(?!//)[!-&(-~]{6,256}+",
    "key": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,64}[0-9])[A-Za-z0-9_+/-]{16,512}+={0,2}",
}
OF_DOCUMENTS = 4  # so many generators learn from the documents as well
GUARDS = {
    "address": r"@|[(\[{]\x20?(?:at|AT)\x20?[)\]}]", "number": r"[0-9][\x20().-]{0,2}[0-9][\x20().-]{0,2}[0-9]",
    "grouped": r"[0-9][.\x20-][0-9]", "network": r"[0-9A-Fa-f][.:][0-9A-Fa-f]",
    "secret": r"[A-Za-z0-9_.-][\"']?\x20{0,2}[=:]\x20{0,2}[\"']?[!-&(-~]{6}", "key": r"[0-9][A-Za-z_+/=-]{0,15}[A-Za-z0-9_+/=-]{4}",
}
SECRET_NAME = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|auth|bearer|(?:api|access|private|client|signing)[_.-]?(?:key|id)|key)s?[\"']?\W*"
CUES = (
    r"(?:tel|phone|call|fax|mobile|cell)\W*$", r"(?:mail|contact|write)\W*$", r"(?:card|visa|credit|account|iban)\W*$",
    r"(?:ip|host|server|address)\W*$", r"(?:version|isbn|no|order|page|v)\W*$",
)
# what only tells strict spans apart, as the sign before a number does, is left out, or the trees would learn just that
FEATURES = ("family", "digits", "separators", "groups", "cue", "luhn", "octets", "domain", "joined", "letters",
            "size", "named")
CONTEXT = 24


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """Leftmost non-overlapping matches as [(start, end, value, before, after)], in code points; `guard` false means there
    are none. `before` and `after` are the text next to a match, up to the matches around it.

    Matches are set off by a character no pattern knows; a text's own such characters are replaced by their neighbour.
    """
    marked = F.regexp_replace(F.translate(text, "\x01", "\x02"), pattern, "\x01$0\x01")

    def placed(parts: Column) -> Column:
        starts = prefix_sums(F.transform(parts, lambda p: F.length(p)))
        spans = bound(starts, lambda s: F.transform(parts, lambda p, i: F.struct(
            F.get(s, i).cast("int").alias("start"), (F.get(s, i).cast("int") + F.length(p)).alias("end"), p.alias("value"),
            F.right(F.coalesce(F.get(parts, i - 1), F.lit("")), F.lit(CONTEXT)).alias("before"),
            F.left(F.coalesce(F.get(parts, i + 1), F.lit("")), F.lit(1)).alias("after"))))
        return F.filter(spans, lambda _, i: i % 2 == 1)

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return F.when(guard, bound(F.split(marked, "\x01"), placed)).otherwise(none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0))), F.lit(0),
                                                 step) % 10 == 0)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return bound(digits_of(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits_of(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The strict spans as [(kind, start, end)], by kind as listed, then by start."""
    guards = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"),
              "card": text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"), "phone": F.contains(text, F.lit("+"))}

    def of(kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind], guards[kind]), lambda m: valid(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*[of(kind) for kind in KINDS])


def known_form(family: int, value: Column) -> Column:
    """Whether a candidate is personal data by its form though no strict pattern takes it as it is written."""
    name = list(GENERATORS)[family]
    if name == "address":
        plain = F.regexp_replace(F.regexp_replace(value, rf"\x20?{_AT}\x20?", "@"), rf"\x20?{_DOT}\x20?", ".")
        return value.rlike(rf"{_AT}|{_DOT}") & plain.rlike(rf"^{_LOCAL}+@{_LABEL}+(?:\.{_LABEL}+)+")
    return value.rlike(IPV6) if name == "network" else F.lit(False)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _features(family: int, m: Column) -> Column:
    value, before, after = m["value"], m["before"], m["after"]

    def build(digits: Column) -> Column:
        n = F.length(digits)
        level = sum((F.when(n >= low, 1).otherwise(0) for low in (1, 7, 10, 12, 16, 20)), F.lit(0))
        others = bound(F.regexp_replace(value, "[0-9+]", ""), lambda o: F.when(o == "", 0).when(o.rlike(r"^\x20+$"), 1).when(
            o.rlike(r"^\.+$"), 2).when(o.rlike("^-+$"), 3).otherwise(4))
        cue = F.lit(0)
        for i, pattern in enumerate(CUES, 1):
            cue = F.when(F.lower(before).rlike(pattern), i).otherwise(cue)
        groups = F.least(F.size(F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")), F.lit(3))
        domain = F.when(value.rlike(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), 1).when(
            value.rlike(r"[(\[{]"), 2).otherwise(0)
        parts = {"family": F.lit(family), "digits": level, "separators": others, "groups": groups,
                 "cue": cue,
                 "luhn": F.when(n.between(12, 19), luhn(digits).cast("int")).otherwise(0),
                 "octets": F.when(valid("ip", value), 1).when(value.rlike(IPV6), 2).otherwise(0), "domain": domain,
                 "joined": after.rlike("[0-9A-Za-z]").cast("int"), "letters": F.lit(0), "size": F.lit(0), "named": F.lit(0)}
        if family >= OF_DOCUMENTS:
            core = F.regexp_replace(value, r"^[A-Za-z][A-Za-z0-9_.-]*+[\"']?\x20*[=:]\x20*[\"']?", "") if family == OF_DOCUMENTS else value
            parts["letters"] = core.rlike("[A-Z]").cast("int") + 2 * core.rlike("[a-z]").cast("int") + 4 * core.rlike(
                "[^A-Za-z0-9\"',;.]").cast("int")
            parts["size"] = sum((F.when(F.length(core) >= low, 1).otherwise(0) for low in (8, 12, 16, 20, 24, 32, 40)), F.lit(0))
            parts["groups"] = F.least(F.size(F.filter(F.split(core, "[^0-9]+"), lambda g: g != "")), F.lit(4))
            parts["named"] = (value.rlike(f"^(?:[A-Za-z0-9_.-]*[_.-])?{SECRET_NAME}[=:]") if family == OF_DOCUMENTS else before.rlike(
                f"{SECRET_NAME}$")).cast("int")
        return F.struct(*[parts[f].cast("int").alias(f) for f in FEATURES])

    return bound(digits_of(value), build)


def candidates(text: Column, base: Column, families: int = len(GENERATORS)) -> Column:
    """All proposed spans as [(start, end, features, strict, positive)]; strict: it overlaps a base span; positive: that, or
    it is personal data in another form."""
    def of(family: int, name: str, pattern: str) -> Column:
        return F.transform(matches(text, pattern, text.rlike(GUARDS[name])), lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), _features(family, m).alias("features"),
            F.exists(base, lambda b: overlaps(m, b)).alias("strict"),
            (F.exists(base, lambda b: overlaps(m, b)) | known_form(family, m["value"])).alias("positive")))

    return F.concat(*[of(i, name, pattern) for i, (name, pattern) in enumerate(GENERATORS.items()) if i < families])


def planted(n: int = 4_000, seed: int = 17, held: bool = False) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with the (start, end) of their secrets, none in the hard negatives; seeded, `held` gives others than are fitted."""
    rng = random.Random(seed + held * 1_000_003)
    lower, upper, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

    def some(letters: str, low: int, high: int) -> str:
        while True:
            made = "".join(rng.choices(letters, k=rng.randint(low, high)))
            if len(letters) < 27 and letters != hexes or any(c in digits for c in made):
                return made

    def word(low: int = 2, high: int = 9) -> str:
        return some(lower, low, high)

    def name() -> str:
        stem = rng.choice(["password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "auth_token", "client_secret",
                           "private-key", "signing.key", "credential", "db_password"])
        return rng.choice([stem, stem.upper(), stem.title(), f"{word(2, 5)}_{stem}"])

    def value() -> str:
        return rng.choice([some(hexes, 12, 64), some(lower + digits, 8, 30), some(lower + upper + digits, 8, 48),
                           some(lower + upper + digits + "!#$%&*+/_-", 9, 32), some(upper + digits, 12, 24)])

    def sign() -> str:
        return rng.choice(["=", ": ", " = ", ":", "="])

    secrets = [lambda: f"{name()}{sign()}{value()}", lambda: f'{name()}{sign()}"{value()}"', lambda: f"{name()}{sign()}'{value()}'",
               lambda: rng.choice(["AKIA", "ASIA", "AIza"]) + some(upper + digits, 16, 16), lambda: some(hexes, 32, 64),
               lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "pk_", "tok_"]) + some(lower + upper + digits, 20, 40),
               lambda: f"bearer {some(lower + upper + digits + '_-', 24, 80)}", lambda: some(lower + upper + digits, 28, 48),
               lambda: ".".join("eyJ" + some(lower + upper + digits, 17, 60) for _ in range(3))]
    plain = [lambda: f"{rng.choice(['page', 'width', 'lang', 'order', 'size', 'color', 'id', 'ref', 'lot'])}{sign()}{rng.randint(100_000, 10**9)}",
             lambda: f"{word(3, 8)}{sign()}{word(6, 14)}", lambda: f"{name()}: {word(6, 12)} {word()}", lambda: word(16, 30),
             lambda: f"{word()}_{word()}_{rng.randint(1990, 2030)}_{word()}.pdf", lambda: f"{word()}-{word()}-{word()}-{rng.randint(1, 99)}-{word()}",
             lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}",
             lambda: f"{word()}: {rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", lambda: some(digits, 16, 19),
             lambda: f"{word(4, 9)}/{word(4, 9)}/{rng.randint(1, 2030)}/{word(4, 12)}", lambda: f"{word().title()}{word().title()}{word().title()}{rng.randint(1, 9)}",
             lambda: f"time: {rng.randint(1, 9)}h{rng.randint(10, 59)}min{rng.randint(10, 59)}s", lambda: "=" * rng.randint(10, 40) + str(rng.randint(1, 9)),
             lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}-{word(4, 6)}", lambda: f"{word()}={word(3, 6)}&{word()}={rng.randint(1, 999)}"]
    out = []
    for _ in range(n):
        is_secret = rng.random() < 0.5
        item = rng.choice(secrets if is_secret else plain)()
        lead = " ".join(word() for _ in range(rng.randint(0, 6)))
        start = len(lead) + bool(lead)
        cue = item.startswith("bearer ") * 7
        out.append((f"{lead} {item}".lstrip() + rng.choice(["", " ", ", ", "\n", ". "]) + " ".join(word() for _ in range(rng.randint(0, 4))),
                    [(start + cue, start + len(item))] if is_secret else []))
    return out


@dataclass
class Trees:
    """Boosted trees of depth two: each is (feature, cut, left part, right part), a part (feature, cut, low, high)."""

    prior: float = 0.0
    trees: list = field(default_factory=list)
    steps: list = field(default_factory=list)  # (least score, probability), ascending
    threshold: float = 0.9
    secrets: Trees | None = None  # judges the candidates of the generators that documents teach nothing about

    def score(self, features: Column) -> Column:
        if not self.trees:
            return F.lit(self.prior)

        def leaf(f: int, cut: int, low, high) -> Column:
            return F.when(features[FEATURES[f]] <= cut, low).otherwise(high)

        # one array and one sum over it: a chain of additions would be as deep as there are trees
        each = [leaf(f, cut, *[leaf(*part) for part in parts]) for f, cut, *parts in self.trees]
        return F.aggregate(F.array(*each), F.lit(self.prior), lambda total, x: total + x)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x)) + self.prior
        for f, cut, *parts in self.trees:
            low, high = (np.where(x[:, g] <= c, a, b) for g, c, a, b in parts)
            total = total + np.where(x[:, f] <= cut, low, high)
        return total

    @property
    def least_score(self) -> float | None:
        """The score from which a candidate is selected; None if there is none."""
        return next((s for s, p in self.steps if p >= self.threshold), None)

    @property
    def selects(self) -> bool:
        return self.least_score is not None or self.secrets is not None and self.secrets.least_score is not None

    def selecting(self, features: Column) -> Column:
        """The score of a candidate that is selected, null for others."""
        def of(model: Trees | None) -> Column:
            if model is None or model.least_score is None:
                return F.lit(None).cast("double")
            return bound(model.score(features).cast("double"), lambda x: F.when(x >= model.least_score, x))

        return F.when(features["family"] < OF_DOCUMENTS, of(self)).otherwise(of(self.secrets))


def _split(x, g, h):
    """Feature, cut and gain of the best single split for gradients g and curvatures h."""
    best = (0, 0, 0.0)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        sums_g, sums_h = np.bincount(x[:, f], g), np.bincount(x[:, f], h)
        left_g, left_h = np.cumsum(sums_g)[:-1], np.cumsum(sums_h)[:-1]
        if not len(left_g):
            continue
        gain = left_g ** 2 / (left_h + 1.0) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1.0) - whole
        cut = int(np.argmax(gain))
        if gain[cut] > best[2] + 1e-9:
            best = (f, cut, float(gain[cut]))
    return best


def boost(x: np.ndarray, positive: np.ndarray, total: np.ndarray, rounds: int = 40, rate: float = 0.3) -> Trees:
    """Trees by Newton steps on the logistic loss; row i stands for `total` candidates."""
    share = (positive.sum() + 0.5) / (total.sum() + 1.0)
    model = Trees(float(np.log(share / (1 - share))))
    score = np.zeros(len(x)) + model.prior
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = positive - total * p, total * p * (1 - p)
        f, cut, gain = _split(x, g, h)
        if gain < 1e-6:
            break
        parts, low = [], x[:, f] <= cut
        for side in (low, ~low):
            sub_f, sub_cut, _ = _split(x[side], g[side], h[side])
            under = side & (x[:, sub_f] <= sub_cut)
            leaf = [float(rate * np.clip(g[s].sum() / (h[s].sum() + 1.0), -4, 4)) for s in (under, side & ~under)]
            parts.append((sub_f, sub_cut, *leaf))
        model.trees.append((f, cut, *parts))
        score = model.scores(x)
    return model


def calibrated(model: Trees, x: np.ndarray, positive: np.ndarray, total: np.ndarray, threshold: float) -> Trees:
    """Probabilities by score, never falling, from candidates of held-out documents (adjacent violators are pooled)."""
    pools = []
    scores = model.scores(x)
    for s in np.unique(scores):
        at = scores == s
        pools.append([float(s), float(positive[at].sum()), float(total[at].sum())])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, p, n = pools.pop()
            pools[-1][1] += p
            pools[-1][2] += n
    model.steps = [(s, p / (n + 2.0)) for s, p, n in pools]
    model.threshold = threshold
    return model


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.95) -> Trees:
    """Trees fitted on the candidates of all `docs` and on the planted examples, calibrated on a fifth of both held out."""
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(text.alias("text"), (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0).alias("held"))
    found = rows.where(F.col("text").rlike(r"[0-9@]|[(\[{]\x20?(?:at|AT)")).select("held", F.explode(
        bound(base_spans(F.col("text")), lambda b: candidates(F.col("text"), b, OF_DOCUMENTS))).alias("c"))
    model = _fitted(found, F.col("c.positive"), threshold)
    lessons = docs.sparkSession.createDataFrame([(t, spans, i % 5 == 0) for i, (t, spans) in enumerate(planted())],
                                                "text string, spans array<struct<start:int,end:int>>, held boolean")
    taught = lessons.select("held", F.col("spans"), F.explode(bound(base_spans(F.col("text")), lambda b: candidates(F.col("text"), b)))
                            .alias("c")).where(F.col("c.features.family") >= OF_DOCUMENTS)
    model.secrets = _fitted(taught, F.exists("spans", lambda p: overlaps(F.col("c"), p)), threshold)
    return model


def _fitted(found: DataFrame, is_positive: Column, threshold: float) -> Trees:
    """Trees of the candidates `c` that are not `held`, calibrated on those that are; Spark counts them per feature vector."""
    counts = found.groupBy("c.features", "held").agg(
        F.sum(is_positive.cast("bigint")).alias("positive"), F.count(F.lit(1)).alias("total")).collect()
    if not counts:
        return Trees()
    counts.sort(key=lambda r: (tuple(r["features"]), r["held"]))
    x = np.array([list(r["features"]) for r in counts], dtype=np.int64)
    positive, total = (np.array([r[c] for r in counts], dtype=float) for c in ("positive", "total"))
    held = np.array([r["held"] for r in counts])
    if held.all() or not held.any():
        return Trees()
    return calibrated(boost(x[~held], positive[~held], total[~held]), x[held], positive[held], total[held], threshold)


def selected(text: Column, base: Column, model: Trees) -> Column:
    """All candidates apart from the base spans whose score selects them, by start; they may overlap."""
    scored = F.transform(F.filter(candidates(text, base), lambda c: ~c["strict"]), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), model.selecting(c["features"]).alias("score"),
        c["features"]["family"].alias("family")))
    chosen = F.filter(scored, lambda c: c["score"].isNotNull())
    return F.array_sort(chosen)


def named(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in GENERATORS])
    return F.transform(spans, lambda c: F.struct(F.get(names, c["family"]).alias("kind"), c["start"].alias("start"),
                                                 c["end"].alias("end")))


def apart(items: Column, also: tuple = ()) -> Column:
    """Of spans by start, those that overlap no better one that stays: best first, by stretches of overlapping spans.

    Spans have start, end, score and family, and keep the fields named in `also`.
    """
    def fold(group: Column) -> Column:
        ranked = F.reverse(F.array_sort(F.transform(group, lambda c: F.struct(
            c["score"].alias("score"), (c["end"] - c["start"]).alias("length"), (-c["start"]).alias("place"),
            c["family"].alias("family"), c["start"].alias("start"), c["end"].alias("end"), *[c[f].alias(f) for f in also]))))
        spans = F.transform(ranked, lambda c: F.struct(*[c[f].alias(f) for f in ("start", "end", "score", "family", *also)]))
        none = F.filter(spans, lambda _: F.lit(False))
        return F.array_sort(F.aggregate(spans, none, lambda kept, c: F.when(
            F.exists(kept, lambda k: overlaps(c, k)), kept).otherwise(F.concat(kept, F.array(c)))))

    def by_stretch(reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: F.get(items, i)["start"] >= F.get(reach, i))
        return bound(heads, lambda h: F.flatten(F.transform(h, lambda i, k: bound(F.slice(
            items, i + 1, F.coalesce(F.get(h, k + 1), F.size(items)) - i), fold))))

    return F.when(F.size(items) > 1, bound(prefix_maxima(F.transform(items, lambda c: c["end"])), by_stretch)).otherwise(items)


def find(docs: DataFrame, model: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the base spans and the added ones [(kind, start, end)] by start; of overlapping candidates the best stays."""
    # step by step, so that each step's expressions are analysed by themselves
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    based = rows.select("id", "text", base_spans(F.col("text")).alias("base"))
    chosen = selected(F.col("text"), F.col("base"), model) if model.selects else None
    if chosen is None:
        return based.select(F.col("id").alias(id_col), "base", F.array().cast(SPANS).alias("added"))
    picked = based.select("id", "base", chosen.alias("chosen"))
    return picked.select(F.col("id").alias(id_col), "base", named(apart(F.col("chosen"))).alias("added"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by its first span's kind in brackets."""
    def rebuilt(ordered: Column) -> Column:
        reach = prefix_maxima(F.transform(ordered, lambda s: s["end"]))
        chars = F.split(text, "")  # one per code point, so that every cut costs its own length only
        return bound(chars, lambda c: bound(reach, lambda r: pieces(ordered, r, c)))

    def pieces(ordered: Column, r: Column, c: Column) -> Column:
        # a span that starts under the reach of those before it belongs to their stretch
        heads = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: F.get(ordered, i)["start"] >= F.get(r, i))
        parts = F.transform(heads, lambda i: F.concat(
            F.array_join(F.slice(c, F.get(r, i).cast("int") + 1, F.get(ordered, i)["start"] - F.get(r, i).cast("int")), ""),
            F.lit("["), F.upper(F.get(ordered, i)["kind"]), F.lit("]")))
        last = F.size(ordered) - 1
        end = F.greatest(F.get(r, last).cast("int"), F.get(ordered, last)["end"])
        return F.concat(F.array_join(parts, ""), F.array_join(F.slice(c, end + 1, F.size(c)), ""))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                                 s["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, bound(ordered, rebuilt)).otherwise(text)


def redacted(docs: DataFrame, model: Trees, *, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """`docs` with all spans of the text column redacted; null texts and all other columns stay as they are, but for
    `length_col`, where it is named, which follows the length of changed texts.
    """
    held = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    based = held.select("_doc", "_t", base_spans(F.col("_t")).alias("_base"))
    # all selected spans, also those a better one overlaps: what they hold beyond it goes as well
    more = named(selected(F.col("_t"), F.col("_base"), model)) if model.selects else F.array().cast(SPANS)
    spans = based.select("_doc", "_t", F.concat("_base", more).alias("_spans"))
    held = spans.select("_doc", F.when(F.col("_doc")[text_col].isNotNull(), redact(F.col("_t"), F.col("_spans"))).alias("_text"))

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("_text").alias(c)
        if c == length_col:
            changed = ~F.col("_text").eqNullSafe(F.col("_doc")[text_col])
            return F.when(changed, F.length("_text")).otherwise(F.col("_doc")[c]).cast(docs.schema[c].dataType).alias(c)
        return F.col("_doc")[c].alias(c)

    return held.select(*[column(c) for c in docs.columns])


def digest(docs: DataFrame, model: Trees) -> DataFrame:
    """The columns the query returns, from `find`."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))), ",")

    found = find(docs, model)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, hex_text(joined(F.col("base"))).alias("base_sha256"),
                        joined(F.concat("base", "added")).alias("spans"),
                        F.size("added").cast("bigint").alias("n_added"))
