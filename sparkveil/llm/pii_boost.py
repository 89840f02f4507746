"""Personal data by candidate gradient boosting, in Spark expressions.

Base spans (email, ip, card, phone) are regular expressions with checks; they always stay. High-recall
generators, several for each kind and for secrets (tokens, keys, passwords), propose further spans, which overlap each
other. Boosted trees score each proposal from its format and context. A proposal is a redaction if its calibrated probability reaches
its kind's threshold, no base span overlaps it, and none overlaps it that is more probable (on a tie: earlier) and a redaction itself.

The trees are fitted in numpy on FITTED examples that a seeded generator writes (no corpus
text is read for it), Platt-calibrated on a second set, and become one CASE expression. Nothing but
DataFrame functions runs on the documents. Offsets are code points, ends exclusive.

Null text counts as empty, and empty texts have no spans. Texts of any length are scanned whole; each pattern starts only where a
run of its characters starts, so a long run costs its length, not its square, and values of any length are proposed; only the spans of
one chain of overlaps cost their square. Repeated rows are judged alike, each on its own. An
empty table gives an empty result. Columns beside those that are named are kept by redacted, whatever their names, and not read elsewhere.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as found_spans

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
FITTED, ROUNDS, DEPTH, RATE, PRECISION = 6000, 40, 4, 0.4, 0.99
MARK, OTHER = "\x01", "\x02"

#: The base patterns. Java's possessive quantifiers and the look-behinds change no match: they only
#: keep a failed run from being tried again at each of its characters. \G lets a match start right after one.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?(?:\(at\)|\[at\]|\{at\})\x20?|\x20at\x20|\x20@\x20?|@\x20)"
_DOT = r"(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20)"
_NAME = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|key|auth|credential|bearer)"
_SPELT = r"(?:[(\[{]at[)\]}]\x20?|\x20at\x20|\x20@\x20?|@\x20)[A-Za-z0-9-]{2,63}(?:\.[A-Za-z0-9-]|\x20?[(\[{]dot[)\]}]|\x20dot\x20)"
_NAMED = rf"(?:[=:]|\x20is)(?<=(?i:{_NAME})[\"']?\x20{{0,3}}(?:[=:]|\x20is))"
#: Candidates beyond the base, by a cheap test that all their matches imply: kind, pattern, and a test of its own.
MORE = {
    _SPELT: (
        ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{1,63}}{_AT}[A-Za-z0-9-]{{2,63}}(?:{_DOT}[A-Za-z0-9-]{{2,24}}){{1,4}}(?![A-Za-z0-9-])", None),
        ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{1,63}}{_AT}[A-Za-z0-9-]{{2,63}}\.[A-Za-z]{{2,24}}(?![A-Za-z0-9-])", None),
    ),
    ":": (
        ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
        ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])", "::"),
    ),
    _NAMED: (("secret", rf"(?<![A-Za-z0-9_+/-])(?<=(?i:{_NAME})[\"']?\x20{{0,3}}(?:=|:|=>|:=|\x20is)\x20{{0,3}}[\"']?)[A-Za-z0-9_+/-][A-Za-z0-9_+/.=-]{{7,}}+", None),),
    "[0-9]": (
        ("card", r"(?<![0-9A-Za-z])[0-9]{4}[\x20./_-][0-9]{4}[\x20./_-][0-9]{4}[\x20./_-][0-9]{1,7}(?![0-9A-Za-z])", r"[0-9]{4}[\x20./_-][0-9]{4}[\x20./_-]"),
        ("card", r"(?<![0-9A-Za-z])[0-9]{4}[\x20./_-][0-9]{6}[\x20./_-][0-9]{5}(?![0-9A-Za-z])", r"[0-9]{4}[\x20./_-][0-9]{6}[\x20./_-]"),
        ("phone", r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])", r"[0-9][)\x20.-]\x20?[0-9]{3,4}[\x20.-][0-9]{3}"),
        ("phone", r"(?<![0-9A-Za-z+.])0[0-9](?:[\x20.-][0-9]{2}){4}(?![0-9A-Za-z])", r"[0-9]{2}[\x20.-][0-9]{2}[\x20.-][0-9]{2}"),
        ("secret", r"(?<![0-9A-Za-z])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{16,}+(?![0-9A-Za-z])", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{16}"),
        ("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+", "[A-Za-z_-][0-9]|[0-9][A-Za-z_-]"),
        ("secret", r"(?<![A-Za-z0-9_-])(?:sk|pk|rk|ghp|gho|glpat|xox[abp]|AKIA|AIza|hf)(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{14,}+", r"(?<![A-Za-z0-9_-])(?:[spr]k|gh[po]|glpat|xox|AKIA|AIza|hf)[A-Za-z0-9_-]{14}"),
    ),
}
#: Words before a value that speak for its kind.
CONTEXT = {
    "email": r"(?:e-?mail|mail|contact|write|reach|correo|kontakt|courriel)",
    "ip": r"(?:\bip\b|ipv6|address|host|server|client)",
    "card": r"(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta)",
    "phone": r"(?:phone|tel\b|tel[.:]|call|mobile|cell|fax|telefon|téléphone|teléfono|whatsapp)",
    "secret": rf"{_NAME}",
}
FEATURES = ("kind", "digits", "length", "luhn", "context", "other", "groups", "letters", "dots", "year", "assigned", "distinct", "hex", "spelt")
#: Words before a value that speak against it.
AGAINST = r"(?:order|invoice|serial|part|version|isbn|item|ref|page|date|sku|batch|look|stay|meet|arriv|commit|sha|digest|checksum|hash|uuid|file)"
#: How a value that is assigned to a name begins.
ASSIGNED = r"(?:=|:|=>)\x20*[\"']?$"
WIDTH = 24


def luhn(digits: str) -> bool:
    total = sum(int(c) if n % 2 == 0 else sum(divmod(2 * int(c), 10)) for n, c in enumerate(reversed(digits)))
    return bool(digits) and total % 10 == 0


def features(kind: str, value: str, left: str) -> list[float]:
    """What the trees see of one candidate; feature_columns is its twin."""
    digits, low = re.sub("[^0-9]", "", value), left.lower()
    return [
        float(ALL_KINDS.index(kind)), float(len(digits)), float(len(value)), float(luhn(digits)), float(bool(re.search(CONTEXT[kind], low))), float(bool(re.search(AGAINST, low))),
        float(len(re.sub(r"[0-9A-Za-z]+", "x", value).replace("x", "")) + 1), float(len(re.sub("[^A-Za-z]", "", value))), float(len(re.sub(r"[^.]", "", value))), float(bool(re.match(r"(?:19|20)[0-9]{2}[^0-9]", value))),
        float(bool(re.search(ASSIGNED, left))), float(len(set(value))), float(bool(re.fullmatch("[0-9A-Fa-f]+", value))), float(bool(re.search(r"[@(\[{]", value))),
    ]


def feature_columns(kind: str, value: Column, left: Column) -> list[Column]:
    digits, low = F.regexp_replace(value, "[^0-9]", ""), F.lower(left)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        F.lit(float(ALL_KINDS.index(kind))), F.length(digits).cast("double"), F.length(value).cast("double"), flag(F.call_function("luhn_check", digits)), flag(low.rlike(CONTEXT[kind])), flag(low.rlike(AGAINST)),
        (F.length(F.regexp_replace(value, "[0-9A-Za-z]+", "")) + 1).cast("double"), F.length(F.regexp_replace(value, "[^A-Za-z]", "")).cast("double"), F.length(F.regexp_replace(value, "[^.]", "")).cast("double"), flag(value.rlike("^(?:19|20)[0-9]{2}[^0-9]")),
        flag(left.rlike(ASSIGNED)), F.size(F.array_distinct(F.split(value, ""))).cast("double"), flag(value.rlike("^[0-9A-Fa-f]+$")), flag(value.rlike(r"[@(\[{]")),
    ]


def examples(n: int, seed: int) -> list[tuple[list[float], int]]:
    """n labelled candidates as the generators propose them, with their left contexts."""
    rng = random.Random(seed)
    of = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    d = lambda k: of("0123456789", k)
    word = lambda a, b: of("abcdefghijklmnoprstuvw", rng.randint(a, b))
    says = {"email": ["email ", "mail: ", "contact me: ", "write to ", ""], "ip": ["ip ", "host ", "from server ", "client ", ""], "card": ["card ", "visa: ", "credit card no. ", "pay by card ", ""], "phone": ["phone ", "tel: ", "call ", "mobile ", "fax ", ""]}
    against = ["order ", "invoice no ", "serial ", "part ", "version ", "isbn ", "ref ", "date ", "sku ", "batch ", "we look ", "arrive ", "stay ", word(3, 9) + " ", word(2, 6) + ", " + word(3, 7) + " "]
    hexes, tokens, names = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", ["token", "secret", "password", "passwd", "api_key", "apikey", "key", "auth", "access_token", "client_secret"]
    out = []
    while len(out) < n:
        kind, good = rng.choice(ALL_KINDS), rng.random() < 0.5
        clue = None
        if kind == "email":
            at, dot = rng.choice([(" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" @ ", "."), ("@ ", ".")]) if good else rng.choice([(" at ", "."), (" at ", " dot ")])
            value = word(3, 9) + at + word(3, 9) + dot + (rng.choice(["com", "org", "net", "de", "fr", "es", "io"]) if good else word(4, 9))
        elif kind == "ip":
            full = ":".join(of(hexes, rng.randint(1, 4)) for _ in range(8))
            short = ":".join(of(hexes, rng.randint(1, 4)) for _ in range(rng.randint(2, 4))) + "::" + ":".join(of(hexes, rng.randint(1, 4)) for _ in range(rng.randint(1, 3)))
            value = rng.choice([full, short]) if good else rng.choice([":".join(d(2) for _ in range(8)), d(1) + "::" + d(1), of("abcdef", 3) + "::" + of("abcdef", 3)])
        elif kind == "card":
            sep = rng.choice("./_" if rng.random() < 0.7 else " -")
            size = rng.choice([15, 14])
            digits = d(size)
            digits = next(digits + c for c in "0123456789" if luhn(digits + c) == (good or rng.random() < 0.1))
            value = sep.join(digits[k : k + 4] for k in range(0, 16, 4)) if size == 15 else sep.join((digits[:4], digits[4:10], digits[10:]))
        elif kind == "phone":
            pairs = "0" + rng.choice("123456789") + "".join(rng.choice(" .-") + d(2) for _ in range(4))
            value = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", pairs]) if good or rng.random() < 0.4 else rng.choice([f"{rng.choice(['19', '20'])}{d(2)}-{d(4)}-{d(4)}", f"{d(2)} {d(3)} {d(3)}", f"{d(4)} {d(4)} {d(4)}"])
        elif good:
            value = rng.choice([of(hexes, rng.choice([16, 20, 24, 32, 40, 48, 64])), of(hexes, rng.choice([32, 40])).upper(), of(tokens, rng.randint(16, 60)), rng.choice(["sk-", "ghp_", "AKIA", "xoxb-", "hf_"]) + of(tokens, rng.randint(16, 40)), word(4, 8) + d(rng.randint(2, 4)) + of(tokens, 3)])
            clue = rng.choice(names) + rng.choice([" = ", "=", ": ", ":", " => ", " is "]) + rng.choice(["", '"', "'"])
            if value[:3] in ("sk-", "ghp", "AKI", "xox", "hf_") and rng.random() < 0.3:
                clue = ""
        else:
            value = rng.choice([word(8, 14), of(hexes, 40), d(rng.randint(16, 20)), word(20, 30), word(6, 12) + "-" + word(6, 12) + "-" + d(4), of(hexes, 8) + "-" + of(hexes, 4) + "-" + of(hexes, 4) + "-" + of(hexes, 12)])
            if value.isalpha() or "-" in value and rng.random() < 0.5:
                clue = rng.choice([rng.choice(names) + " is ", rng.choice(names) + ": ", "the key: ", ""])
            else:
                clue = rng.choice(["commit ", "sha ", "digest: ", "uuid ", "file ", "checksum = ", "", word(3, 8) + " ", word(3, 8) + ". "])
        if clue is None:
            clue = rng.choice(says[kind][:-1] if good and (kind == "phone" or rng.random() < 0.7) else [""] if good else against)
        left = (word(2, 8) + " " + word(2, 8) + " " + clue)[-WIDTH:]
        out.append((features(kind, value, left), int(good)))
    return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, cut, left, right) or a leaf value."""
    leaf = float(-g.sum() / (h.sum() + 1))
    if not depth:
        return leaf
    best, base = None, g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1][:: max(1, len(np.unique(x[:, f])) // 24)]:
            low = x[:, f] <= cut
            if low.sum() < 20 or (~low).sum() < 20:
                continue
            gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - base
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, float(cut), low)
    if best is None or best[0] < 1e-3:
        return leaf
    _, f, cut, low = best
    return f, cut, _tree(x[low], g[low], h[low], depth - 1), _tree(x[~low], g[~low], h[~low], depth - 1)


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@functools.cache
def model(fitted: int = FITTED, rounds: int = ROUNDS, seed: int = 11):
    """(trees, slope, offset, threshold by kind), the same on every call."""
    train, held = examples(fitted, seed), examples(fitted // 2, seed + 1)
    x, y = np.array([e[0] for e in train]), np.array([e[1] for e in train], dtype=float)
    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, p - y, p * (1 - p), DEPTH)
        trees.append(tree)
        score += RATE * np.array([_value(tree, r) for r in x])
    hx, hy = [e[0] for e in held], np.array([e[1] for e in held], dtype=float)
    hs = np.array([sum(RATE * _value(t, r) for t in trees) for r in hx])
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling
        p = 1 / (1 + np.exp(-(a * hs + b)))
        a, b = a - 0.05 * float(((p - hy) * hs).mean()), b - 0.05 * float((p - hy).mean())
    p, cuts = 1 / (1 + np.exp(-(a * hs + b))), {}
    for k, kind in enumerate(ALL_KINDS):
        own = np.array([r[0] == k for r in hx])
        order = sorted(zip(p[own].tolist(), hy[own].tolist(), strict=True), reverse=True)
        right, cut = 0.0, 1.0
        for n, (q, good) in enumerate(order, 1):
            right += good
            if right / n >= PRECISION:
                cut = q
        cuts[kind] = max(0.5, cut)
    return trees, a, b, cuts


def probability(row: list[float]) -> float:
    trees, a, b, _ = model()
    return float(1 / (1 + np.exp(-(a * sum(RATE * _value(t, row) for t in trees) + b))))


def _case(tree, columns: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(columns[f] <= cut, _case(low, columns)).otherwise(_case(high, columns))


def score(row: Column) -> Column:
    """The calibrated probability of a candidate, from the array of its features."""
    trees, a, b, _ = model()
    total = functools.reduce(lambda x, y: x + y, (_case(t, [row[k] for k in range(len(FEATURES))]) for t in trees)) * F.lit(RATE)
    return 1 / (1 + F.exp(-(total * F.lit(a) + F.lit(b))))


_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def found(text: Column, pattern: str, rank: int, kind: str) -> Column:
    """All matches, leftmost and not overlapping, as an array of _SPAN. text must not hold MARK."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    make = lambda start, end, part: F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), part.alias("value"))
    return found_spans.odd_parts(parts, make, f"array<{_SPAN}>")


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, value>> by start, then kind as listed."""
    guards = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")}

    def of(rank: int, kind: str) -> Column:
        hits = F.filter(found(text, BASE[kind], rank, kind), lambda s: _valid(kind, s["value"]))
        return F.when(guards[kind], hits).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return F.array_sort(F.concat(*(of(*x) for x in enumerate(KINDS))))


def proposals(text: Column) -> Column:
    """What all generators propose: array<struct<span, f>> with the features of each."""
    kind_of = f"array<struct<span:{_SPAN},f:array<double>>>"

    none = F.array().cast(kind_of)

    def of(kind: str, pattern: str, guard: str | None) -> Column:
        def seen(s: Column) -> Column:
            left = F.substring(text, F.greatest(s["start"] - WIDTH, F.lit(0)) + 1, F.least(s["start"], F.lit(WIDTH)))
            return F.struct(s.alias("span"), F.array(*feature_columns(kind, s["value"], left)).alias("f"))

        hits = F.transform(found(text, pattern, ALL_KINDS.index(kind), kind), seen).cast(kind_of)
        return F.when(text.rlike(guard), hits).otherwise(none) if guard else hits

    return F.concat(*(F.when(text.rlike(guard), F.concat(*(of(*x) for x in several))).otherwise(none) for guard, several in MORE.items()))


def selected(base: Column, proposed: Column) -> Column:
    """The proposals that are redactions, by start: array<_SPAN>.

    Of the proposals that reach their threshold, the most probable one is taken first, then each that overlaps no base span and nothing taken
    before. Only spans of one chain of overlaps are held against each other.
    """
    cuts = F.create_map(*(F.lit(x) for kind, cut in model()[3].items() for x in (kind, cut)))
    kind = f"struct<start:int,p:double,end:int,span:{_SPAN}>"
    rated = lambda p, span: F.struct(span["start"].alias("start"), p.alias("p"), span["end"].alias("end"), span.alias("span"))
    kept = F.filter(F.transform(proposed, lambda c: rated(score(c["f"]), c["span"])), lambda c: c["p"] >= F.element_at(cuts, c["span"]["kind"]))
    sure = F.transform(base, lambda s: rated(F.lit(2.0), s))
    empty = F.array().cast(f"array<{_SPAN}>")

    def best(chain: Column) -> Column:
        ranked = F.array_sort(F.transform(chain, lambda c: F.struct((-c["p"]).alias("by"), c["start"].alias("start"), c["span"].alias("span"))))
        apart = lambda taken, c: ~F.exists(taken, lambda t: (t["start"] < c["span"]["end"]) & (c["start"] < t["end"]))
        # base spans come first and all stay, also those that overlap
        taken = F.aggregate(ranked, empty, lambda acc, c: F.when((c["by"] < -1) | apart(acc, c), F.array_append(acc, c["span"])).otherwise(acc))
        firm = F.transform(F.filter(ranked, lambda c: c["by"] < -1), lambda c: c["span"])
        several = F.array_sort(F.slice(taken, F.size(firm) + 1, F.size(taken)))
        return F.when(F.size(chain) > 1, several).when(chain[0]["p"] > 1, empty).otherwise(F.array(chain[0]["span"]))

    some = lambda k: F.when(F.size(k) > 0, found_spans.chains(F.array_sort(F.concat(k, sure)).cast(f"array<{kind}>"), best, kind, _SPAN)).otherwise(empty)
    return F.when(F.size(proposed) > 0, found_spans.bind(kept, some)).otherwise(empty)


def with_spans(df: DataFrame, text: Column, columns: list[Column]) -> DataFrame:
    """`columns` of df with _base and _more, sorted arrays of _SPAN; _more are the spans that the trees add. Names in `columns` are the caller's."""
    body = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(OTHER))
    rows = df.select(*columns, body.alias("_body"))
    rows = rows.select("*", base_spans(F.col("_body")).alias("_base"), proposals(F.col("_body")).alias("_proposed")).drop("_body")
    return rows.select("*", selected(F.col("_base"), F.col("_proposed")).alias("_more"))


def _joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added (spans of the trees)."""
    rows = with_spans(docs, F.col(text), [F.col(doc_id).alias("doc_id")])
    counts = [F.size(F.filter("_base", (lambda k: lambda x: x["kind"] == k)(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.array_sort(F.concat("_base", "_more"))
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("_more").cast("long").alias("n_added"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `text` rewritten: each stretch of overlapping spans becomes <KIND> of the first of them. Null text stays null; other columns stay, whatever their names."""
    rows = with_spans(docs, F.col(text), [F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")])
    stretch = "struct<start:int,end:int,kind:string>"
    end = lambda chain: F.array_max(F.transform(chain, lambda s: s["end"]))
    merged = lambda chain: F.array(F.struct(chain[0]["start"].alias("start"), end(chain).alias("end"), chain[0]["kind"].alias("kind")))
    rows = rows.withColumn("_all", found_spans.chains(F.array_sort(F.concat("_base", "_more")), merged, _SPAN, stretch))
    size, all_ = found_spans.BLOCK, F.col("_all")
    end_of = lambda k: F.when(k > 0, all_[F.greatest(k - 1, F.lit(0))]["end"]).otherwise(0)  # noqa: E731  where the text before stretch k ends

    def block(b: Column) -> Column:
        """The text from the end of the block before to the end of this one; cut from the text once, and then in itself."""
        first, last = b * size, F.least((b + 1) * size, F.size(all_))
        at = end_of(first)
        inner = lambda part: F.array_join(F.transform(F.sequence(first, last - 1), lambda k: F.concat(F.substr(part, end_of(k) - at + 1, all_[k]["start"] - end_of(k)), F.lit("<"), F.upper(all_[k]["kind"]), F.lit(">"))), "")
        return found_spans.bind(F.substr(F.col("_text"), at + 1, end_of(last) - at), inner)

    blocks = F.transform(F.sequence(F.lit(0), ((F.size(all_) - 1) / size).cast("int")), block)
    new = F.concat(F.array_join(blocks, ""), F.substr(F.col("_text"), end_of(F.size(all_)) + 1))
    rows = rows.withColumn("_new", F.when(F.size(all_) > 0, new).otherwise(F.col("_text")))
    return rows.select(*(F.col("_new").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns))
