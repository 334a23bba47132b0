r"""Personal data: exact base spans, and further ones that boosted trees pick from looser candidates. Native throughout.

- Base spans: a regular expression for each kind and a check of what it finds. Where a pattern could rescan a run of
  characters from each of its places, it starts only where such a run starts, or where the match before ended (``\G``).
- Candidates: looser patterns of the same kinds, several for each, which overlap one another and the base spans.
- Examples: what a candidate is can't be read off the base patterns, as those that they match are found already. So each base
  span is rewritten in the looser ways people write such data, and stands, where it was found, as a right candidate; and
  rewritten with what makes it one broken (checksum, range, top-level domain; for telephone numbers what stands around
  them), as a wrong one. Candidates of the texts that fail their check, or lie in a base span of another kind, are wrong too;
  those that pass it are what is to be decided, and no examples. A few own examples let a corpus without base spans be searched.
- Trees: small regression trees on the logistic loss, over format (digits, separators, writing, checksum) and context
  (neighbours, words before). Features are small integers, so the training set is a table of feature vectors with counts. Its
  size is bounded by the product of their ranges, whatever the number of texts.
- Thresholds: per kind, the lowest score at which those examples that a hash of their text holds out are right often enough.
- Redaction: of candidates above it that meet no base span, the furthest above first, none overlapping another.

Spans meet by sorted windows over the spans of one text, so a text of very many spans takes no quadratic time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellate.llm._common import cut, shuffle_partitions, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Ways to write @ and a dot: in brackets, or set apart.
AT = r"(?:\x20?@\x20?|\x20?[(\[{<](?i:at)[)\]}>]\x20?)"
DOT = r"(?:\.|\x20\.\x20|\x20?[(\[{](?i:\.|dot)[)\]}]\x20?|\x20(?i:dot)\x20)"
MARK = r"[\x20\u00a0\u2010-\u2015./_-]"
#: (kind, pattern): candidates of one pattern don't overlap, those of different ones may.
LOOSE = (
    ("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++"),
    ("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++\x20(?i:at)\x20[A-Za-z0-9-]++(?:\x20(?i:dot)\x20[A-Za-z0-9-]++)++"),
    ("ip", rf"(?<![0-9.])[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}(?![0-9])"),
    ("card", rf"(?<![0-9])[0-9](?:{MARK}{{0,3}}[0-9]){{12,18}}(?![0-9])"),
    ("card", rf"(?<![0-9])[0-9]{{4}}(?:{MARK}{{1,3}}[0-9]{{4}}){{3}}(?![0-9])"),
    ("phone", rf"(?<![0-9])(?:(?:\+|00)?[0-9]{{1,3}}{MARK})?\(?[0-9]{{3}}\)?{MARK}{{1,2}}[0-9]{{3}}{MARK}[0-9]{{4}}(?![0-9])"),
    ("phone", rf"(?<![0-9])\([0-9]{{3}}\){MARK}?[0-9]{{3}}{MARK}[0-9]{{4}}(?![0-9])"),
)
EMAIL_GUARD = r"@|(?i)[(\[{<]at[)\]}>]|\x20at\x20[a-z0-9-]+\x20dot\x20"
#: Words right before personal data of each kind, and before numbers of other sorts.
CUES = {
    "email": r"(?i)(?:mail|contact|write|send)\w*(?:\W+\w{1,8})?\W{0,3}$",
    "ip": r"(?i)(?:\bip|addr|host|server|client)\w*(?:\W+\w{1,8})?\W{0,3}$",
    "card": r"(?i)(?:card|visa|amex|master|credit|payment)\w*(?:\W+\w{1,8})?\W{0,3}$",
    "phone": r"(?i)(?:phone|\btel|call|fax|mobile|contact)\w*(?:\W+\w{1,8})?\W{0,3}$",
}
OTHER_CUES = r"(?i)\b(?:order|invoice|isbn|serial|ref|reference|part|item|version|code)\W+(?:(?:id|no|number|code)\W+){0,2}$"
TOP_DOMAINS = r"(?i)(?:com|org|net|edu|gov|mil|info|biz|io|co|eu|uk|ca|au|de|fr|es|nl|ch|se|pl|ru|jp|cn|br|mx)$"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
#: Own examples, (kind, value, before, after): what is known where a corpus has no base spans.
SEEDS = (
    ("email", "jane.doe@mail.example.org", "write to ", " "), ("email", "sam7@example.com", "and ", ","), ("email", "k.li@example.net", "", "\n"),
    ("ip", "192.0.2.17", "from ", " "), ("ip", "198.51.100.204", "host ", "."), ("ip", "203.0.113.9", "", ""),
    ("card", "4111111111111111", "card ", " "), ("card", "5500005555555559", "with ", "."), ("card", "4012888888881881", "", ""),
    ("phone", "+1 (202) 555-0143", "call ", " "), ("phone", "+44 131 496 0018", "is ", "."), ("phone", "+1 303 555 0171", "", ""),
)
FEATURES = ("digits", "marks", "writing", "checksum", "front", "back", "cue")
VECTOR = ", ".join(f"{f}: int" for f in FEATURES)
BLOCK = 512
ROUNDS = 12
DEPTH = 3
RATE = 0.5
PRECISION = 0.98


def _found(df: DataFrame, patterns: list[tuple[str, bool, str, Column]]) -> DataFrame:
    """(_id, spans): of patterns (kind, loose, pattern, guard), all matches in those ``_text`` that pass the guard.

    A span is (kind, loose, start, end, value, before, after). Where it starts is the sum of the lengths before it; the sums
    run in blocks, so that a text of many matches takes no quadratic time.
    """
    none = F.array().cast("array<string>")
    df = df.withColumns({
        f"{x}{i}": F.when(guard, of).otherwise(none)
        for i, (_, _, p, guard) in enumerate(patterns)
        for x, of in (("m", F.regexp_extract_all("_text", F.lit(p), F.lit(0))), ("p", F.split("_text", p, -1)))
    })
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(loose).alias("loose"), F.col(f"m{i}").alias("m"), F.col(f"p{i}").alias("p")) for i, (k, loose, _, _) in enumerate(patterns)])

    def steps(w: Column) -> Column:
        return F.transform(w.m, lambda v, i: (F.length(F.get(w.p, i)) + F.when(i > 0, F.length(F.get(w.m, i - 1))).otherwise(0)).cast("long"))

    def running(x: Column) -> Column:
        start = F.array().cast("array<long>")
        return F.aggregate(x, start, lambda a, v: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + v)))

    def blocks(w: Column) -> Column:
        count = F.ceil(F.size(w.steps) / F.lit(BLOCK)).cast("int")
        return F.when(count == 0, F.array().cast("array<array<long>>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda b: running(F.slice(w.steps, b * BLOCK + 1, BLOCK))))

    def located(w: Column) -> Column:
        def span(v: Column, i: Column) -> Column:
            at = (i / BLOCK).cast("int")
            start = F.get(F.get(w.blocks, at), i % BLOCK) + F.coalesce(F.get(w.before, at - 1), F.lit(0).cast("long"))
            return F.struct(
                w.kind.alias("kind"), w.loose.alias("loose"), start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"),
                F.right(F.get(w.p, i), F.lit(24)).alias("before"), F.left(F.get(w.p, i + 1), F.lit(2)).alias("after"),
            )

        return F.transform(w.m, span)

    each = F.transform(each, lambda w: w.withField("steps", steps(w)))
    each = F.transform(each, lambda w: w.withField("blocks", blocks(w)))
    each = F.transform(each, lambda w: w.withField("before", running(F.transform(w.blocks, lambda b: F.element_at(b, -1)))))
    return df.select("_id", F.flatten(F.transform(each, located)).alias("spans"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""

    def weight(digits, i):
        d = F.substring(digits, -i - 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(
        F.array(_digits(value)),
        F.lit(0),
        lambda a, x: F.aggregate(F.sequence(F.lit(0), F.length(x) - 1), F.lit(0), lambda b, i: b + weight(x, i)),
    )
    return total % 10 == 0


def _by_kind(kind: Column, of: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(kind == k, c) for k, c in of.items()])


def _valid(s: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    n = F.length(_digits(s.value))
    card = F.when(n.between(14, 19), _luhn(s.value)).otherwise(False)
    return _by_kind(s.kind, {"email": F.lit(True), "ip": s.value.rlike(IP_PARTS), "card": card, "phone": n.between(10, 15)})


def _side(x: Column, marks: str) -> Column:
    """What a neighbour is: nothing, white space, a digit, a letter, one of ``marks`` that a sentence has there, another sign."""
    return (
        F.when(F.coalesce(F.length(x), F.lit(0)) == 0, 0).when(x.rlike(r"^\s"), 1).when(x.rlike("^[0-9]"), 2)
        .when(x.rlike(r"^\p{L}"), 3).when(x.rlike(marks), 4).otherwise(5)
    )


def _features(c: Column) -> Column:
    """What FEATURES says of a candidate. A checksum of 0 can't be of the kind; else the larger, the better it fits it."""
    value, digits = c.value, F.length(_digits(c.value))
    tail = F.regexp_extract(value, "([A-Za-z0-9-]*)$", 1)
    checksum = _by_kind(c.kind, {
        "email": F.when(tail.rlike(f"^{TOP_DOMAINS}"), 2).when(tail.rlike("^[A-Za-z]{2,24}$"), 1).otherwise(0),
        "ip": F.regexp_replace(value, "[^0-9]+", ".").rlike(IP_PARTS).cast("int"),
        "card": F.when(digits.between(13, 19), _luhn(value)).otherwise(False).cast("int"),
        "phone": digits.between(10, 15).cast("int"),
    })
    cued = _by_kind(c.kind, {k: c.before.rlike(p) for k, p in CUES.items()})
    return F.struct(
        F.least(digits, F.lit(20)).alias("digits"),
        F.least(F.size(F.array_distinct(F.split(F.regexp_replace(value, "[A-Za-z0-9]", ""), ""))), F.lit(6)).alias("marks"),
        F.when(value.rlike(r"(?i)\x20(?:at|dot)\x20"), 2).when(value.rlike(r"[\[{<]|\([a-zA-Z.]"), 1).otherwise(0).alias("writing"),
        checksum.alias("checksum"),
        _side(F.right(c.before, F.lit(1)), r"^[(\[{\"':;,>]").alias("front"),
        _side(c.after, r"^(?:[)\]}\"':;!?<]|[.,](?![0-9]))").alias("back"),
        F.when(cued, 2).when(c.before.rlike(OTHER_CUES), 0).otherwise(1).alias("cue"),
    ).cast(f"struct<{VECTOR}>")


#: Ways to rewrite a base span of each kind, and to break one.
WAYS = {"email": (5, 3), "ip": (4, 2), "card": (6, 2), "phone": (7, 8)}
ENDS = "~. ~, "


def _nth(options: str, i: Column) -> Column:
    """The i-th of options, which a tilde sets apart."""
    return F.get(F.split(F.lit(options), "~"), i.cast("int"))


def _rewritten(kind: Column, value: Column, i: Column) -> Column:
    """A base span's value in the i-th looser way of writing."""
    local, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    digits = _digits(value)
    country, own = F.substring(digits, F.lit(1), F.length(digits) - 10), F.right(digits, F.lit(10))
    form = _nth("($1) $2-$3~$1-$2-$3~$1.$2.$3~$1 $2 $3~$1/$2/$3~$1-$2-$3~$1 $2 $3", i)
    country = F.when((i > 4) & F.length(country).between(1, 3), F.concat(_nth("~~~~~~00", i), country, _nth("~~~~~-~ ", i))).otherwise("")
    return _by_kind(kind, {
        "email": F.concat(local, _nth(" @ ~(at)~ [at] ~ (at) ~ at ", i), F.replace(domain, F.lit("."), _nth(".~.~ [dot] ~ dot ~ dot ", i))),
        "ip": F.replace(value, F.lit("."), _nth("[.]~ . ~(dot)~ dot ", i)),
        "card": F.regexp_replace(digits, F.lit("([0-9]{4})(?=[0-9])"), F.concat(F.lit("$1"), _nth(".~/~_~ - ~\u2013~\u00a0", i))),
        "phone": F.concat(country, F.regexp_replace(own, F.lit("^(.{3})(.{3})(.{4})$"), form)),
    })


def _broken(kind: Column, value: Column, j: Column) -> Column:
    """A base span's value with what makes it one broken in the j-th way; what breaks a telephone number is around it."""
    last = (F.right(value, F.lit(1)).cast("int") + 1 + 2 * j) % 10
    return F.coalesce(_by_kind(kind, {
        "email": F.regexp_replace(value, F.lit(r"\.[^.]*$"), _nth(".7~.x~.patterns", j)),
        "ip": F.regexp_replace(value, _nth("^[0-9]+~[0-9]+$", j), _nth("999~260", j)),
        "card": F.concat(F.substring(value, F.lit(1), F.length(value) - 1), last.cast("string")),
    }), value)


def _example(c: Column, pick: Column, wrong: Column) -> Column:
    """The pick-th right or wrong example of a base span, anywhere in a sentence: the fields of a candidate, and right."""
    of = lambda n: _by_kind(c.kind, {k: F.lit(w[n]) for k, w in WAYS.items()})
    i, e, j = pick % of(0), F.floor(pick / of(0)) % 4, F.floor(pick / (4 * of(0))) % of(1)
    around = wrong & (c.kind == "phone")
    before = F.when(around & (j < 4), _nth("order id ~serial no. ~PN-~x", j)).otherwise(c.before)
    after = F.when(around & (j >= 4), _nth("-7~/2~x~.5", j - 4)).when(e == 3, c.after).otherwise(_nth(ENDS, e))
    value = _rewritten(c.kind, F.when(wrong, _broken(c.kind, c.value, j)).otherwise(c.value), i)
    none = F.lit(-1).cast("long")
    return F.struct(
        c.kind.alias("kind"), none.alias("start"), none.alias("end"), value.alias("value"), before.alias("before"), after.alias("after"),
        F.when(wrong, 0).otherwise(1).alias("right"),
    )


def _described(c: Column) -> Column:
    return F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"), c.right.alias("right"), _features(c).alias("x"))


def detect(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, base, candidates, examples): a text's base spans (kind, start, end), its candidates (also right, which is null, and x,
    the features), and a right and a wrong example of each base span, chosen by a hash of it (the same; no start and end)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"))
    # Columns of their own, so that a guard is looked for once and not once a pattern.
    rows = rows.withColumns({"_at": F.col("_text").contains("@"), "_loose_at": F.col("_text").rlike(EMAIL_GUARD), "_digit": F.col("_text").rlike("[0-9]")})
    exact = [(k, False, p, F.col("_at" if k == "email" else "_digit")) for k, p in BASE.items()]
    rows = _found(rows, exact + [(k, True, p, F.col("_loose_at" if k == "email" else "_digit")) for k, p in LOOSE])
    rows = rows.select("_id", F.filter("spans", lambda s: ~s.loose & _valid(s)).alias("base"), F.filter("spans", lambda s: s.loose).alias("loose"))
    pick = lambda s: F.crc32(F.concat(s.value, s.start.cast("string")).cast("binary"))
    made = F.flatten(F.transform("base", lambda s: F.transform(F.array(F.lit(False), F.lit(True)), lambda w: _example(s, pick(s), w))))
    found = F.transform("loose", lambda s: F.struct(*[s[x].alias(x) for x in ("kind", "start", "end", "value", "before", "after")], F.lit(None).cast("int").alias("right")))
    rows = rows.select("_id", "base", F.transform(F.concat(found, made), _described).alias("told"))
    return rows.select(
        "_id", F.transform("base", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))).alias("base"),
        F.filter("told", lambda c: c.right.isNull()).alias("candidates"), F.filter("told", lambda c: c.right.isNotNull()).alias("examples"),
    )


def seeds(spark) -> DataFrame:
    """Every example of SEEDS: (kind, x, right)."""
    rows = spark.createDataFrame([(*s, 4 * WAYS[s[0]][0] * WAYS[s[0]][1]) for s in SEEDS], "kind string, value string, before string, after string, n int")
    each = rows.withColumn("pick", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("wrong", F.explode(F.array(F.lit(False), F.lit(True))))
    made = each.select(_example(F.struct("kind", "value", "before", "after"), F.col("pick"), F.col("wrong")).alias("e"))
    return made.select(_described(F.col("e")).alias("e")).select("e.kind", "e.x", "e.right")


def meet(detected: DataFrame) -> DataFrame:
    """(_row, _id, kind, start, end, x, free, wrong) of each candidate; once where several patterns find it.

    free: no base span overlaps it. wrong: it fails its check, or lies in base spans of other kinds alone.
    Base spans and candidates of a text are laid side by side by where they start: of those that start before or with a
    candidate, the one that ends last may reach into it; of those that start after it, the first may start inside it.
    """
    spans = detected.filter(F.size("candidates") > 0).select("_row", "_id", F.explode(F.concat(
        F.transform("candidates", lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"), c.x.alias("x"))),
        F.transform("base", lambda b: F.struct(b.kind.alias("kind"), b.start.alias("start"), b.end.alias("end"), F.lit(None).cast(f"struct<{VECTOR}>").alias("x"))),
    )).alias("s")).select("_row", "_id", "s.*").distinct()
    own = lambda c, k: F.when(F.col("x").isNull() & (F.col("kind") == k), F.col(c))
    on = Window.partitionBy("_row").orderBy("start", F.col("x").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("_row").orderBy(F.col("start").desc(), F.col("x").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumns({f"_until_{k}": F.max(own("end", k)).over(on) for k in KINDS}).withColumns({f"_from_{k}": F.min(own("start", k)).over(back) for k in KINDS})
    met = {k: (F.coalesce(F.col(f"_until_{k}") > F.col("start"), F.lit(False)) | F.coalesce(F.col(f"_from_{k}") < F.col("end"), F.lit(False))) for k in KINDS}
    any_ = met["email"] | met["ip"] | met["card"] | met["phone"]
    same = F.coalesce(*[F.when(F.col("kind") == k, met[k]) for k in KINDS])
    return spans.filter("x IS NOT NULL").select(
        "_row", "_id", "kind", "start", "end", "x", (~any_).alias("free"), (~same & (any_ | (F.col("x.checksum") == 0))).alias("wrong")
    )


class Trees:
    """Boosted trees of DEPTH levels over a table of (feature vector, right, wrong)."""

    def __init__(self, rows: list[tuple[tuple[int, ...], float, float]], rounds: int = ROUNDS):
        right, all_ = sum(r[1] for r in rows), sum(r[1] + r[2] for r in rows)
        self.start = math.log((right + 1) / (all_ - right + 1))
        self.trees: list = []
        margin = [self.start] * len(rows)
        for _ in range(rounds if rows else 0):
            p = [1 / (1 + math.exp(-m)) for m in margin]
            g = [(r[1] + r[2]) * q - r[1] for r, q in zip(rows, p)]
            h = [(r[1] + r[2]) * q * (1 - q) for r, q in zip(rows, p)]
            tree = self._grow([r[0] for r in rows], g, h, list(range(len(rows))), DEPTH)
            self.trees.append(tree)
            margin = [m + self._value(tree, r[0]) for m, r in zip(margin, rows)]

    def _grow(self, x, g, h, own, depth):
        """(feature, cut, below, above), or a leaf's value; the first of equally good splits."""
        gs, hs = sum(g[i] for i in own), sum(h[i] for i in own)
        best = (1e-9, None)
        for f in range(len(FEATURES)) if depth else ():
            sums: dict[int, list[float]] = {}
            for i in own:
                s = sums.setdefault(x[i][f], [0.0, 0.0])
                s[0] += g[i]
                s[1] += h[i]
            gl = hl = 0.0
            for at in sorted(sums)[:-1]:
                gl, hl = gl + sums[at][0], hl + sums[at][1]
                gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                if gain > best[0]:
                    best = (gain, (f, at))
        if best[1] is None:
            return -RATE * gs / (hs + 1)
        f, at = best[1]
        return f, at, *(self._grow(x, g, h, [i for i in own if (x[i][f] <= at) == low], depth - 1) for low in (True, False))

    def _value(self, tree, x) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, x: tuple[int, ...]) -> float:
        return self.start + sum(self._value(t, x) for t in self.trees)

    def column(self, x: Column) -> Column:
        """The score as an expression over a feature vector."""

        def of(tree):
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(x[FEATURES[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        out = F.lit(float(self.start))
        for tree in self.trees:
            out = out + of(tree)
        return out


def threshold(scored: list[tuple[float, float, float]], precision: float) -> float:
    """Of (score, right, wrong), the lowest score down to which ``precision`` of all are right, and most of that score itself.

    It is halfway to the next score below, or to a log odds of zero if that is nearer; not over the lowest score itself.
    """
    levels: dict[float, list[float]] = {}
    for score, right, wrong in scored:
        level = levels.setdefault(score, [0.0, 0.0])
        level[0] += right
        level[1] += wrong
    limit, right, all_ = math.inf, 0.0, 0.0
    order = sorted(levels, reverse=True)
    for score, below in zip(order, [*order[1:], -math.inf]):
        a, b = levels[score]
        right, all_ = right + a, all_ + a + b
        if right >= precision * all_ and a > b:
            limit = min(score, max((score + below) / 2, 0.0))
    return limit


def train(detected: DataFrame, candidates: DataFrame, precision: float = PRECISION) -> dict[str, tuple[Trees, float]]:
    """Trees and threshold for each kind, from examples and from candidates that are wrong.

    The examples of a fifth of the texts, by a hash, set the thresholds; where it has no right ones, all examples do.
    """
    held = F.coalesce(F.pmod(F.xxhash64("_id"), F.lit(5)) == 0, F.lit(True)).alias("held")
    rows = detected.select(held, F.explode("examples").alias("e")).select("held", "e.kind", "e.x", "e.right")
    rows = rows.unionByName(candidates.filter("wrong").select(held, "kind", "x", F.lit(0).alias("right")))
    rows = rows.unionByName(seeds(detected.sparkSession).select(F.lit(False).alias("held"), "*")).coalesce(shuffle_partitions(detected.sparkSession))
    counted = (
        rows.groupBy("held", "kind", *[F.col(f"x.{f}").alias(f) for f in FEATURES])
        .agg(F.sum("right").alias("right"), F.sum(1 - F.col("right")).alias("wrong"))
        .collect()
    )
    out = {}
    for kind in KINDS:
        rows = sorted((r.held, tuple(r[f] for f in FEATURES), float(r.right), float(r.wrong)) for r in counted if r.kind == kind)
        trees = Trees([r[1:] for r in rows if not r[0]])
        aside = [r for r in rows if r[0]]
        limit = threshold([(trees.score(r[1]), r[2], r[3]) for r in (aside if any(r[2] for r in aside) else rows)], precision)
        if limit < math.inf:
            out[kind] = trees, limit
    return out


def _chosen(candidates: DataFrame, known: dict[str, tuple[Trees, float]]) -> DataFrame:
    """(_row, more): of each text's free candidates over their threshold, the furthest above first, none overlapping another.

    Those that overlap one another, or are linked by others that do, come in a run; a choice is one within its run.
    """
    above = F.coalesce(*[F.when(F.col("kind") == k, t.column(F.col("x")) - F.lit(limit)) for k, (t, limit) in known.items()], F.lit(-1.0))
    by_start = Window.partitionBy("_row").orderBy("start", "end", "kind")
    picked = candidates.filter("free").withColumn("above", above).filter("above >= 0")
    new = F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    runs = picked.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct((-F.col("above")).alias("o"), "start", "end", "kind")
    span = lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"))
    taken = F.aggregate(
        "by", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"),
        lambda a, c: F.when(F.exists(a, lambda s: (s.start < c.end) & (c.start < s.end)), a).otherwise(F.concat(a, F.array(span(c)))),
    )
    each = runs.groupBy("_row", "_run").agg(F.array_sort(F.collect_list(order)).alias("by")).select("_row", taken.alias("taken"))
    return each.groupBy("_row").agg(F.flatten(F.collect_list("taken")).alias("more"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.element_at(rank, s.kind).alias("rank"), s.end.alias("end"), s.kind.alias("kind")))
    return F.array_sort(keyed)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_email, n_ip, n_card, n_phone, base_spans, spans, added.

    - base_spans and spans: kind:start:end, comma-joined, by start and then kind as listed in KINDS; code points, the end
      not included. The counts and base_spans are of base spans; spans holds those and ``added`` more.
    - null and empty texts: no spans. Very long texts: searched whole, in time that grows with their length and spans.
    - null ids and repeated rows: each row gets its spans. Ties of candidates: the one that starts first, then ends first.
    - empty table: no rows. Further columns, whatever they are called, are neither read nor returned.
    """
    detected = cut(detect(df, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    candidates = cut(meet(detected))
    more = _chosen(candidates, train(detected, candidates)).withColumnRenamed("_row", "_of")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    rows = detected.join(more, F.col("_row") == F.col("_of"), "left").select("_id", "base", F.coalesce("more", none).alias("more"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return rows.select(
        F.col("_id").alias(id_col),
        *[count(k).alias(f"n_{k}") for k in KINDS],
        _joined(_ordered(F.col("base"))).alias("base_spans"),
        _joined(_ordered(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("added"),
    )


def op10_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans", "added")


QUERIES = {"op10_pii": op10_pii}
ORACLE: dict[str, str] = {}
