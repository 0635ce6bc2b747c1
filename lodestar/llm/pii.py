"""Personal data: overlapping candidates, boosted trees over format and context, calibrated redaction; DataFrame functions only.

Base patterns with their validators (octets, Luhn, digit counts) are always reported. High-recall generators propose more spans,
also overlapping ones: groups of digits, addresses spelled out with or without brackets, account numbers. Each candidate is described
by a few features of a handful of values each: its format (generator, digits, separators, shape; a leading plus is masked) and its
context (characters beside it, the kind of cue word before it).

What teaches the trees are weak labels that do not repeat the base patterns. A candidate counts as personal if it lies in a validated
base span (seen without its plus), if an address is one once its (at) and (dot) are spelled back, if an account number has the right
check digits, or if a number of a plausible length follows a cue of its kind. Everything else counts against: dates, order numbers,
numbers that fail their check. So the trees learn which formats and surroundings personal data have in this corpus, and judge every
candidate, labelled or not; a candidate outside the base spans is reported if its probability reaches the threshold of its kind,
the smallest one with the wanted precision on the documents held out for calibration.

The trees are grown on the table of counts by description, which Spark aggregates and which has at most CELLS rows whatever the
input; the grown model is a column expression.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .spans import find_all, let

_LOCAL = "[A-Za-z0-9._%+-]"
#: Possessive forms of the base patterns: the same matches without stack or backtracking, however long the text.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Kinds of base spans, then of those that the trees add.
KINDS = ("email", "ip", "card", "phone", "spelt_email", "local_phone", "account")
BASE = 4
#: Generators: groups of digits with separators; addresses spelled out with brackets, and with words; international account numbers.
DIGITS = r"(?<![0-9])[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
SPELT = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++(?:\x20?[(\[](?i:at)[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?)[A-Za-z0-9-]++)++"
SAID = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20(?i:at)\x20[A-Za-z0-9-]++(?:\x20(?i:dot)\x20[A-Za-z0-9-]++)++"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
GENERATORS = (DIGITS, SPELT, SAID, IBAN)
#: Cue words by kind: telephone, payment, address, papers.
CUES = (
    r"(?i)(?:phone|tel|telefon|téléphone|teléfono|call|fax|mobile|cell|whatsapp)\W{0,3}(?:\w{0,8}\W{0,3})?$",
    r"(?i)(?:card|visa|mastercard|account|konto|iban|acct)\W{0,3}(?:\w{0,8}\W{0,3})?$",
    r"(?i)(?:e-?mail|mail|contact|write to|reach \w{2,4}|address)\W{0,3}(?:\w{0,8}\W{0,3})?$",
    r"(?i)(?:ssn|social security|passport|tax id|licence|license)\W{0,3}(?:\w{0,8}\W{0,3})?$",
)
#: Numbers of values of the features, in the order of _features().
BINS = (4, 8, 5, 4, 4, 5, 4)
CELLS = math.prod(BINS)

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of 10."""

    def add(s: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(s["odd"], 2).otherwise(1)
        return F.struct((s["sum"] + F.when(d > 9, d - 9).otherwise(d)).cast("int").alias("sum"), (~s["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda s: s["sum"] % 10 == 0)


def _iban_ok(m: Column) -> Column:
    """Whether the check digits of an account number leave 1 modulo 97, letters counting 10 to 35."""
    flat = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(flat, 5, 60), F.left(flat, F.lit(4))), "")

    def add(s: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (s * 100 + code - 55) % 97).otherwise((s * 10 + code - 48) % 97).cast("int")

    return F.aggregate(turned, F.lit(0), add, lambda s: s == 1)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end), by kind and start."""
    ip_ok = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

    def card_ok(x):
        n = F.length(_digits(x["match"]))
        return n.between(16, 19) & _luhn(_digits(x["match"]))

    parts = [
        find_all(text, EMAIL, F.contains(text, F.lit("@"))),
        F.filter(find_all(text, IP, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), lambda x: x["match"].rlike(ip_ok)),
        F.filter(find_all(text, CARD, text.rlike(CARD)), card_ok),
        F.filter(find_all(text, PHONE, F.contains(text, F.lit("+")) & text.rlike(PHONE)), lambda x: F.length(_digits(x["match"])).between(8, 15)),
    ]

    def tagged(k: int, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return F.concat(*[tagged(k, p) for k, p in enumerate(parts)])


def generated(text: Column) -> Column:
    """Candidates of all generators, overlaps included: array of (generator, start, end, match, before, after)."""

    def tagged(k: int, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(k).alias("kind"), *[x[c].alias(c) for c in ("start", "end", "match", "before", "after")]))

    return F.concat(*[tagged(k, find_all(text, rx, text.rlike(rx))) for k, rx in enumerate(GENERATORS)])


def _cue(x: Column) -> Column:
    """0: no cue before the candidate, else 1 and up by CUES."""
    out = F.lit(0)
    for k in reversed(range(len(CUES))):
        out = F.when(x["before"].rlike(CUES[k]), k + 1).otherwise(out)
    return out


def _features(x: Column) -> list[Column]:
    def beside(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[A-Za-z0-9_]$"), 2).otherwise(3)

    bare = F.regexp_replace(x["match"], r"^\+", "")
    digits = F.length(_digits(bare))
    marks = F.length(bare) - digits - F.length(F.regexp_replace(bare, "[^A-Za-z]", ""))
    shape = F.when(bare.rlike(r"^(?:19|20)[0-9]{2}([./-])[0-9]{1,2}\1[0-9]{1,2}|^[0-9]{1,2}([./-])[0-9]{1,2}\2(?:19|20)[0-9]{2}"), 1).when(bare.rlike(r"^[0-9]+\.[0-9]+$"), 2).when(bare.rlike("^0"), 3).otherwise(0)
    return [
        x["kind"],
        F.when(digits < 7, 0).when(digits < 9, 1).when(digits < 11, 2).when(digits < 13, 3).when(digits < 16, 4).when(digits == 16, 5).when(digits < 20, 6).otherwise(7),
        F.least(marks, F.lit(4)),
        beside(F.right(x["before"], F.lit(1))),
        beside(x["after"]),
        _cue(x),
        shape,
    ]


def _kind(x: Column, cue: Column) -> Column:
    """The kind as which a candidate would be reported."""
    long_ = F.length(_digits(x["match"])) > 15
    return F.when(x["kind"].isin(1, 2), 4).when((x["kind"] == 3) | long_ | cue.isin(2, 4), 6).otherwise(5)


def _weak(x: Column, cue: Column) -> Column:
    """Weak label of a candidate that no base span holds."""
    n = F.length(_digits(x["match"]))
    alone = ~F.right(x["before"], F.lit(1)).rlike("[A-Za-z0-9_]") & ~x["after"].rlike("[A-Za-z0-9_]")
    number = ((cue == 1) & n.between(7, 15)) | ((cue == 2) & n.between(8, 19)) | ((cue == 4) & n.between(7, 12))
    back = F.regexp_replace(F.regexp_replace(x["match"], r"(?i)\x20?[(\[]at[)\]]\x20?|\x20at\x20", "@"), r"(?i)\x20?[(\[]dot[)\]]\x20?|\x20dot\x20", ".")
    address = back.rlike(r"^[A-Za-z0-9._%+-]*[A-Za-z0-9]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$")
    return F.when(x["kind"] == 0, number & alone).when(x["kind"] == 1, address).when(x["kind"] == 2, address & (cue == 3)).otherwise(_iban_ok(x["match"]))


class Trees:
    """Logistic gradient boosting of depth-two trees over a table of weighted descriptions."""

    def __init__(self, rounds: int = 24, rate: float = 0.4, smooth: float = 1.0):
        self.rounds, self.rate, self.smooth = rounds, rate, smooth
        self.bias, self.trees = 0.0, []

    def fit(self, rows: list[tuple[tuple[int, ...], float, float]]) -> "Trees":
        """``rows``: description, number of positive and of all candidates."""
        pos, n = sum(r[1] for r in rows), sum(r[2] for r in rows)
        p = (pos + 0.5) / (n + 1)
        self.bias = math.log(p / (1 - p))
        score = [self.bias] * len(rows)
        for _ in range(self.rounds):
            odds = [1 / (1 + math.exp(-s)) for s in score]
            grad = [a - m * q for (_, a, m), q in zip(rows, odds, strict=True)]
            hess = [m * q * (1 - q) for (_, _, m), q in zip(rows, odds, strict=True)]
            root = self._best(range(len(rows)), rows, grad, hess)
            if root is None:
                break
            leaves = []
            for side in (False, True):
                part = [i for i in range(len(rows)) if (rows[i][0][root[0]] >= root[1]) == side]
                cut = self._best(part, rows, grad, hess) or (0, 0)
                values = []
                for deep in (False, True):
                    own = [i for i in part if (rows[i][0][cut[0]] >= cut[1]) == deep]
                    values.append(self.rate * sum(grad[i] for i in own) / (sum(hess[i] for i in own) + self.smooth))
                leaves.append((cut, values))
            tree = (root, leaves)
            self.trees.append(tree)
            score = [s + self._leaf(tree, x) for s, (x, _, _) in zip(score, rows, strict=True)]
        return self

    def _best(self, part, rows, grad, hess):
        """The cut (feature, least value of the upper side) of largest gain; one pass a feature, then a sum over its values."""
        best, gain = None, 1e-9
        g_all, h_all = sum(grad[i] for i in part), sum(hess[i] for i in part)
        for f, bins in enumerate(BINS):
            gs, hs = [0.0] * bins, [0.0] * bins
            for i in part:
                gs[rows[i][0][f]] += grad[i]
                hs[rows[i][0][f]] += hess[i]
            g = h = 0.0
            for v in range(bins - 1, 0, -1):
                g, h = g + gs[v], h + hs[v]
                got = g * g / (h + self.smooth) + (g_all - g) ** 2 / (h_all - h + self.smooth) - g_all**2 / (h_all + self.smooth)
                if got > gain + 1e-12:
                    best, gain = (f, v), got
        return best

    @staticmethod
    def _leaf(tree, x) -> float:
        (f, v), leaves = tree
        (g, u), values = leaves[x[f] >= v]
        return values[x[g] >= u]

    def probability(self, x) -> float:
        return 1 / (1 + math.exp(-self.bias - sum(self._leaf(t, x) for t in self.trees)))

    def column(self, features: list[Column]) -> Column:
        total = F.lit(self.bias)
        for (f, v), leaves in self.trees:
            low, high = [F.when(features[g] >= u, values[1]).otherwise(values[0]) for (g, u), values in leaves]
            total = total + F.when(features[f] >= v, high).otherwise(low)
        return 1 / (1 + F.exp(-total))


def threshold(model: Trees, rows, precision: float) -> float:
    """Smallest probability from which on held-out candidates have at least ``precision``.

    Where there are none to calibrate on, the model's own probability must reach ``precision``; where none of them
    qualifies, it must also exceed all that were seen to fail.
    """
    order = sorted(((model.probability(x), a, m) for x, a, m in rows if m), reverse=True)
    best, pos, n = None, 0.0, 0.0
    for k, (p, a, m) in enumerate(order):
        pos, n = pos + a, n + m
        if (k + 1 == len(order) or order[k + 1][0] < p) and pos >= precision * n:
            best = p
    if best is not None:
        return best * (1 - 1e-9)
    return max(precision, order[0][0] * (1 + 1e-9)) if order else precision


def scan(docs: DataFrame, precision: float = 0.9, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``, an array of (kind, start, end, probability), by kind and start.

    ``kind`` numbers KINDS; base spans have probability 1. Calibration uses the third of the documents whose hash says so; the
    trees use the others, and each kind has its threshold. Null and empty texts have no spans; texts are read whole,
    however long. Repeated rows each get their row and count in training as often as they occur; candidates of one
    description are judged alike, so there are no ties to break. An empty table gives no rows. Only the two named columns are read, so
    that further columns, whatever their names, are neither looked at nor returned.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"))
    own = own.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(3)))
    names = [f"f{i}" for i in range(len(BINS))]

    def judged(base: Column) -> Column:
        def one(x: Column) -> Column:
            held = F.exists(base, lambda b: (b["start"] <= x["start"] + 1) & (x["end"] <= b["end"] + 1))
            described = [c.cast("int").alias(n) for n, c in zip(names, _features(x), strict=True)]
            cue = _cue(x)
            return F.struct(_kind(x, cue).cast("int").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *described, held.alias("held"), (held | _weak(x, cue)).alias("personal"))

        return F.struct(base.alias("base"), F.transform(generated(F.col("text")), one).alias("seen"))

    # the base spans are bound once: a column named in a lambda would be computed anew for every candidate
    own = stage(own.select("doc_id", "fold", let(base_spans(F.col("text")), judged).alias("b")).select("doc_id", "fold", "b.base", "b.seen"), "pii")
    each = own.select((F.col("fold") == 0).alias("later"), F.explode("seen").alias("s"))
    cells = each.groupBy("later", F.col("s.kind").alias("kind"), *[F.col(f"s.{n}").alias(n) for n in names]).agg(F.count_if("s.personal").alias("pos"), F.count("*").alias("n"))
    rows = cells.collect()  # at most 2 * 3 * CELLS rows, as descriptions are few
    table = [[(r.kind, tuple(r[n] for n in names), r.pos, r.n) for r in rows if r.later == later] for later in (False, True)]
    model = Trees().fit([r[1:] for r in table[0]]) if table[0] else Trees()
    least = {k: threshold(model, [r[1:] for r in table[1] if r[0] == k], precision) for k in range(BASE, len(KINDS))}

    def scored(s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), model.column([s[n] for n in names]).alias("probability"))

    def reaches(x: Column) -> Column:
        out = F.lit(False)
        for k, p in least.items():
            out = out | ((x["kind"] == k) & (x["probability"] >= p))
        return out

    certain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), F.lit(1.0).alias("probability")))
    others = F.filter(F.transform(F.filter("seen", lambda s: ~s["held"]), scored), reaches)
    return own.select("doc_id", F.array_sort(F.concat(certain, others)).alias("spans"))


def combinations_of_bins():
    """All descriptions there can be (for tests of the bound)."""
    return product(*map(range, BINS))
