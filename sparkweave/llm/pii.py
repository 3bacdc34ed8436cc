r"""Personal data spans by DataFrame functions only: patterns propose, checksums confirm, context adjusts the score.

For each kind a pattern's matches (regexp_extract_all) and the gaps between them (split by the same pattern) give every
match's place as running sums of code points. A match must pass its kind's check: four parts of at most 255, Luhn over
13 to 19 digits, 9 to 15 digits, ISO 13616 mod-97. Failing matches are dropped and not tried again: these are the base
spans of email, ip, card and phone. Further spans come from stricter patterns (a card or phone number that stands in a
longer run of digits, an IBAN, an access key or password) where no base span of their kind lies. A score starts from
the kind's own weight and rises if a context word stands within 40 code points before the span.

Separators inside numbers and domains are first replaced, one for one, by private-use marks, so that every pattern is
a plain character run: no pattern can recurse or backtrack over long texts. Null texts count as empty and have no
spans; empty and repeated texts get equal rows; columns other than those kept are not read. Time grows in proportion to a
text and its spans.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, let, scan

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = 4  # of them have base spans
_JOIN, _DOT = "", ""
#: Weight of a kind's span and the words nearby that raise it. Fixed values.
_WEIGHT = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.7}
_CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|address|server|host|login", "card": "card|credit|visa|payment|pay",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank|transfer", "secret": "key|secret|token|password|aws",
}
#: Length of an IBAN by its country (ISO 13616 registry, and the countries that use the form without an entry).
_IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG CV",
    25: "AO LY PT ST MZ", 26: "DZ IR IS TR", 27: "BF BI BJ CF CG CM DJ FR GA GR IT KM MC MG MR SM TD TG GQ GW",
    28: "AL AZ BY CI CY DO GT HU LB ML NE NI PL SN SV HN MA YE", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in _IBAN.items())
_ONE = "struct<start:int,end:int,score:double>"
_SPAN = f"array<{_ONE}>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(_digits(c))
    doubled = F.transform(
        F.split(d, ""),
        lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)


def _mod97(c: Column) -> Column:
    """ISO 13616: the first four characters go to the end, letters count from 10, the number is 1 modulo 97."""
    plain = F.regexp_replace(c, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(a, x):
        value = F.when(x.between("0", "9"), x.cast("int")).otherwise(F.ascii(x) - 55)
        return F.when(value > 9, a * 100 + value).otherwise(a * 10 + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), lambda a, x: step(a, x).cast("int")) == 1


def _octets(c: Column) -> Column:
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return c.rlike(f"^{part}(?:\\.{part}){{3}}$")


#: kind, is a base kind, cheap test of the text, pattern over the marked text, check of a match.
_RULES = (
    ("email", True, lambda t: t.contains("@"), f"(?:\\G|(?<![A-Za-z0-9._%+\\-{_DOT}]))[A-Za-z0-9._%+\\-{_DOT}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++", None),
    ("ip", True, lambda t: t.rlike("[0-9]\\.[0-9]++\\.[0-9]"), "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", _octets),
    ("card", True, lambda t: t.rlike("[0-9](?:[ -]?[0-9]){12}"), f"[0-9][0-9{_JOIN}]++", _luhn),
    ("phone", True, lambda t: t.contains("+"), "\\+[0-9][ ().0-9-]+[0-9]", lambda c: F.length(_digits(c)).between(9, 15)),
    ("card", False, lambda t: t.rlike("[0-9]{13}"), "(?<![0-9])[0-9]{13,19}+(?![0-9])", _luhn),
    ("phone", False, lambda t: t.contains("+"), "\\+[0-9]{1,3} \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}(?![0-9])", None),
    ("iban", False, lambda t: t.rlike("[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11}"), f"(?<![A-Za-z0-9])(?:{_IBANS})(?![A-Za-z0-9])", _mod97),
    ("secret", False, lambda t: t.rlike("AKIA|="), "(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?:password|passwd|secret|token|api_key)=[^\\x20\\x09-\\x0D]+)", None),
)


def _marked(kind: str, base: bool, text: Column) -> Column:
    """The text with the separators of a number or a domain replaced by a mark of the same length."""
    if kind == "card" and base:
        return F.regexp_replace(text, "(?<=[0-9])[ -](?=[0-9])", _JOIN)
    if kind == "email":
        return F.regexp_replace(text, "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", _DOT)
    return text


def _spans(kind: str, base: bool, text: Column) -> Column:
    """array of (start, end, score) of one rule, in order of place."""
    _, _, test, pattern, check = next(r for r in _RULES if r[:2] == (kind, base))
    marked = _marked(kind, base, text)
    found = F.regexp_extract_all(marked, F.lit(pattern), F.lit(0))
    gaps = F.split(marked, pattern, -1)
    both = let(found, lambda f: F.zip_with(F.slice(gaps, 1, F.size(f)), f, lambda g, m: F.struct(g.alias("gap"), m.alias("hit"))))

    def emit(at, x):
        start = at + F.length(x["gap"])
        near = F.lower(F.right(x["gap"], F.lit(40))).rlike(f"(?:{_CONTEXT[kind]})")
        score = F.when(near, F.lit(min(1.0, _WEIGHT[kind] + 0.1))).otherwise(F.lit(_WEIGHT[kind]))
        good = check(x["hit"]) if check else F.lit(True)
        span = F.array(F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), score.alias("score"))).cast(_SPAN)
        return F.when(good, span).otherwise(F.array().cast(_SPAN))

    after = lambda at, x: at + F.length(x["gap"]) + F.length(x["hit"])
    out = scan(both, F.lit(0), after, emit, _ONE)
    return F.when(test(text), out).otherwise(F.array().cast(_SPAN))


def _apart(spans: Column, own: Column) -> Column:
    """Those spans that overlap none of own; both are in order and free of overlaps of their own.

    Walked from either end: on the way up a span must start at or behind the end of the last own one, on the way down it
    must end at or before the start of the next own one.
    """
    tag = lambda a, t: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(t).alias("own"), s["end"].alias("end"), s["score"].alias("score")))
    kind, none = "struct<start:int,own:int,end:int,score:double>", F.array().cast("array<struct<start:int,own:int,end:int,score:double>>")

    def walk(items, start, at, clear):
        return scan(items, F.lit(start), lambda s, x: F.when(x["own"] == 1, at(s, x)).otherwise(s), lambda s, x: F.when((x["own"] == 1) | clear(s, x), F.array(x)).otherwise(none), kind)

    # at one start the own span comes first on the way up, and so last on the way down
    every = F.array_sort(F.concat(tag(own, 1), tag(spans, 2)))
    up = walk(every, 0, lambda s, x: F.greatest(s, x["end"]), lambda s, x: x["start"] >= s)
    down = walk(F.reverse(up), (1 << 31) - 1, lambda s, x: F.least(s, x["start"]), lambda s, x: x["end"] <= s)
    left = F.filter(F.reverse(down), lambda x: x["own"] == 2)
    return F.when((F.size(spans) == 0) | (F.size(own) == 0), spans).otherwise(F.transform(left, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"))))


def find(df: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """keep columns (default doc_id), and for each kind base and all spans: arrays of (kind, start, end, score).

    base: base spans by kind, then start. all: base and added spans by kind, then start. Places count code points from
    0, ends are exclusive.
    """
    keep = ["doc_id"] if keep is None else keep
    clean = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), _JOIN + _DOT, "��")
    rules = [(kind, base) for kind, base, *_ in _RULES]
    name = lambda kind, base: f"__{kind}_{'base' if base else 'more'}"
    out = df.select(*[F.col(f"`{c}`") for c in keep], clean.alias("__clean"))
    out = out.select(*keep, *[_spans(kind, base, F.col("__clean")).alias(name(kind, base)) for kind, base in rules])

    def named(kind, spans):
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))

    base = [named(kind, F.col(name(kind, True))) for kind in KINDS[:BASE]]
    every = []
    for kind in KINDS:
        own = F.col(name(kind, True)) if (kind, True) in rules else F.array().cast(_SPAN)
        if (kind, False) in rules:
            new = _apart(F.col(name(kind, False)), own)
            own = F.array_sort(F.concat(own, new)) if kind in KINDS[:BASE] else new
        every.append(named(kind, own))
    return out.select(*keep, F.concat(*base).alias("base"), F.concat(*every).alias("all"))


def text_of(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores_of(spans: Column) -> Column:
    """The score of each span in the order of text_of, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The same rows and columns with each span of a score of at least `least` replaced by its kind, such as [EMAIL].

    Overlapping spans are replaced as one, under the kind of the first. Null texts stay null.
    """
    columns = df.columns
    found = find(df, keep=columns, text=text)
    order = F.array_sort(F.transform(F.filter("all", lambda s: s["score"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    body = F.col(f"`{text}`")

    part, none = "struct<from:int,to:int,kind:string>", F.array().cast("array<struct<from:int,to:int,kind:string>>")
    pieces = scan(order, F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.when(s["start"] >= at, F.array(F.struct(at.alias("from"), s["start"].alias("to"), F.upper(s["kind"]).alias("kind")))).otherwise(none), part)

    def joined(c):
        """The text of a chunk's pieces, cut out of the text once and then each out of that."""
        first = F.get(c, F.lit(0))["from"]
        region = body.substr(first + 1, F.get(c, F.size(c) - 1)["to"] - first)
        return let(region, lambda r: F.array_join(F.transform(c, lambda p: F.concat(r.substr(p["from"] - first + 1, p["to"] - p["from"]), F.lit("["), p["kind"], F.lit("]"))), ""))

    tail = body.substr(F.array_max(F.transform(order, lambda s: s["end"])) + 1, F.length(body))
    clean = F.when(F.size(order) == 0, body).otherwise(F.concat(F.array_join(F.transform(let(pieces, chunks), joined), ""), tail))
    new = F.when(F.size("all") > 0, clean).otherwise(body)
    return found.select(*[new.alias(text) if c == text else F.col(f"`{c}`") for c in columns])
