"""Personal data in texts: patterns propose, checks confirm, words nearby weigh.

Each kind has one regular expression.  ``regexp_extract_all`` gives its leftmost
non-overlapping matches and ``split`` by the same expression what lies between them, so
positions are running sums of lengths, and the words around a match are the ends of its
neighbouring pieces; nothing searches a text twice for a place.  A match is then

- confirmed or refused by its kind's check: parts of an address at most 255, Luhn's sum of
  a card, the number of a phone's digits, ``mod 97`` of a bank account, groups of a social
  security number that were never given out;
- scored in hundredths: a value of its kind, and more if one of the kind's words stands
  within ``BEFORE`` characters before it or ``AFTER`` after it.

The four base kinds (email, ip, card, phone) stay whatever their score.  Three kinds are
added where their score reaches ``threshold``: bank accounts (iban), social security
numbers (ssn) and cards of 13 to 15 digits (shortcard); the last two only near such words.

DataFrame and SQL functions only.  Expressions are written with possessive repeats and
starts at the left end of a run, so their time is linear in a text's length and Java's
stack does not grow with it; the matches are those of the plain ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

BEFORE, AFTER = 48, 24
THRESHOLD = 50
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: a run starts where no character of it precedes, or where the last match ended
_START = r"(?:\G|(?<!{0}))"

EMAIL = _START.format(_LOCAL) + rf"{_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
IP = _START.format("[0-9]") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is divisible by 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces, its first four characters moved to the end and letters read as 10 to 35, leaves 1 modulo 97."""
    moved = F.concat(F.substr(account, F.lit(5)), F.left(account, F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    fold = lambda s, c: (s * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), fold) == 1


def _octets(match: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.ltrim(part, F.lit("0"))
        return F.when(F.length(plain) <= 3, F.concat(F.lit("0"), plain).cast("int") <= 255).otherwise(False)

    return F.forall(F.split(match, r"\."), small)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _numbered(low: int, high: int, check=None):
    """A check of how many digits a match has, then of those."""

    def run(match: Column) -> Column:
        digits = _digits(match)
        fits = F.length(digits).between(low, high)
        return fits if check is None else F.when(fits, check(digits)).otherwise(False)

    return run


def _issued(match: Column) -> Column:
    return ~F.left(match, F.lit(3)).isin("000", "666") & (F.left(match, F.lit(1)) != "9") & (F.substring(match, 5, 2) != "00") & (F.right(match, F.lit(4)) != "0000")


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes and ``check`` confirms; ``edge`` is a class of characters that may stand on neither side of a match."""

    name: str
    pattern: str
    check: object
    score: int
    words: str
    needs: str  # a character that every match holds; texts without it are not searched
    base: bool = True
    edge: str | None = None
    near: int = 25


_CARD_WORDS = "card|visa|master|amex|credit|karte|carte|tarjeta"
KINDS = (
    Kind("email", EMAIL, None, 90, "mail|contact|write", "@"),
    Kind("ip", IP, _octets, 60, "ip|host|server|address", "."),
    Kind("card", CARD, _numbered(16, 19, luhn), 70, _CARD_WORDS, ""),
    Kind("phone", PHONE, _numbered(8, 15), 60, "tel|phone|call|fax|mobil|tél", "+"),
    Kind("iban", IBAN, lambda m: F.when(F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34), mod97(F.replace(m, F.lit(" "), F.lit("")))).otherwise(False), 75, "iban|account|bank|konto|compte|cuenta", "", False, "[A-Za-z0-9]"),
    Kind("ssn", SSN, _issued, 30, "ssn|social|security", "-", False, "[0-9-]"),
    Kind("shortcard", CARD, _numbered(13, 15, luhn), 30, _CARD_WORDS, "", False, "[A-Za-z0-9+.]"),
)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, though ``use`` names it in lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def running_ends(lengths: Column, chunk: int = 1024) -> Column:
    """Running sums of an array of numbers, in chunks so that the time isn't quadratic."""
    none, zero = F.array().cast("array<long>"), F.lit(0).cast("long")
    add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["all"], s["at"] + x).alias("all"))
    sums = lambda xs, start: F.aggregate(xs, F.struct(start.alias("at"), none.alias("all")), add, lambda s: s["all"])
    total = lambda xs: F.aggregate(xs, zero, lambda s, x: s + x)
    last = lambda xs: F.floor((F.size(xs) - 1) / F.lit(chunk)).cast("int")
    parts = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last(xs))), lambda i: F.slice(xs, i * chunk + 1, chunk))
    before = lambda ps: F.concat(F.array(zero), sums(F.transform(F.slice(ps, 1, F.size(ps) - 1), total), zero))
    return _bound(lengths, lambda xs: _bound(parts(xs), lambda ps: F.flatten(F.zip_with(ps, before(ps), sums))))


_SPAN = "kind:string,start:bigint,end:bigint,score:int"


def _judged(kind: Kind, at: int, threshold: int) -> Column:
    """``array<struct<kind, start, end, score, stands>>``, one for each match of the ``at``-th pattern; see :func:`_matched`."""
    matches, pieces, ends = (F.col(f"_pii_{c}{at}") for c in "mpe")
    count = F.size(matches)
    rows = F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, count).alias("before"), F.slice(pieces, 2, count).alias("after"), ends.alias("e"))
    rows = F.when(count > 0, rows.cast("array<struct<m:string,before:string,after:string,e:bigint>>")).otherwise(F.array().cast("array<struct<m:string,before:string,after:string,e:bigint>>"))

    def judge(r: Column) -> Column:
        around = F.concat(F.right(r["before"], F.lit(BEFORE)), F.lit("\n"), F.left(r["after"], F.lit(AFTER)))
        score = F.lit(kind.score) + F.when(F.lower(around).rlike(kind.words), kind.near).otherwise(0)
        stands = F.lit(True) if kind.check is None else kind.check(r["m"])
        if kind.edge is not None:
            stands = stands & ~F.right(r["before"], F.lit(1)).rlike(kind.edge) & ~F.left(r["after"], F.lit(1)).rlike(kind.edge)
        if not kind.base:
            stands = stands & (score >= threshold)
        return F.struct(F.lit(kind.name).alias("kind"), (r["e"] - F.length(r["m"])).alias("start"), r["e"].alias("end"), score.alias("score"), stands.alias("stands"))

    return F.transform(rows, judge)


def _matched(docs: DataFrame, kinds: tuple[Kind, ...]) -> tuple[DataFrame, list[str]]:
    """``docs`` with each pattern's matches ``_pii_m``, the pieces between them ``_pii_p`` and the matches' ends ``_pii_e``; the patterns."""
    patterns = list(dict.fromkeys(k.pattern for k in kinds))
    needs = {k.pattern: k.needs for k in kinds}
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    # each step is its own projection: what later steps use often is computed once
    found = docs
    for i, p in enumerate(patterns):
        every = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        found = found.withColumn(f"_pii_m{i}", F.when(F.contains(text, F.lit(needs[p])), every).otherwise(none) if needs[p] else every)
    for i, p in enumerate(patterns):
        found = found.withColumn(f"_pii_p{i}", F.when(F.size(f"_pii_m{i}") > 0, F.split(text, p, -1)).otherwise(none))
    for i in range(len(patterns)):
        m, pieces = F.col(f"_pii_m{i}"), F.col(f"_pii_p{i}")
        steps = F.zip_with(F.slice(pieces, 1, F.size(m)), m, lambda a, b: (F.length(a) + F.length(b)).cast("long"))
        found = found.withColumn(f"_pii_e{i}", F.when(F.size(m) > 0, running_ends(steps)))
    return found, patterns


def find_personal_data(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with ``spans``: an array of ``kind, start, end, score``, in the order of ``kinds`` and then of places.

    Places are code points from 0, the end exclusive.  A null or empty text has no spans;
    texts of any length are searched whole; rows are looked at one by one, so repeated
    rows and null ids are as any other.  A column ``spans`` of ``docs`` is replaced, others stay.
    """
    found, patterns = _matched(docs, kinds)
    stand = lambda k: F.transform(F.filter(_judged(k, patterns.index(k.pattern), threshold), lambda s: s["stands"]), lambda s: F.struct(*[s[f].alias(f) for f in ("kind", "start", "end", "score")]))
    spans = F.concat(*[F.coalesce(stand(k), F.array().cast(f"array<struct<{_SPAN}>>")) for k in kinds])
    return found.withColumn("spans", spans).drop(*[f"_pii_{c}{i}" for c in "mpe" for i in range(len(patterns))])


def mask_personal_data(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets; a kind's spans are found after earlier kinds are masked.

    Null texts stay null; other columns stay as they are.
    """
    for kind in kinds:
        found, _ = _matched(docs, (kind,))
        shown = F.zip_with("_pii_m0", _judged(kind, 0, threshold), lambda m, j: F.when(j["stands"], F.lit(f"<{kind.name}>")).otherwise(m))
        joined = F.array_join(F.flatten(F.zip_with("_pii_p0", F.array_append(shown, F.lit("")), lambda a, b: F.array(a, b))), "")
        masked = F.when(F.size("_pii_m0") > 0, joined).otherwise(F.col("text"))
        docs = found.select(*[masked.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return docs


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [k.name for k in KINDS if k.base]
    found = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    of = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(_joined(of(*base)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).cast("long").alias("top_score"),
    )


def _sql() -> str:
    """The query in SQL: matches and pieces side by side as rows, positions as running sums."""
    plain = {
        EMAIL: rf"{_LOCAL}+@{_HOST}+(?:\.{_HOST}+)+",
        IP: r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        CARD: r"[0-9](?:[\x20-]?[0-9])+",
    }
    found = " union all ".join(
        f"select id, '{n}' grp, unnest(string_split_regex(t, '{plain.get(p, p)}')) piece, unnest(list_concat(regexp_extract_all(t, '{plain.get(p, p)}'), [null])) m, generate_subscripts(string_split_regex(t, '{plain.get(p, p)}'), 1) i from d"
        for n, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("iban", IBAN), ("ssn", SSN))
    )
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum([case when (len({digits}) - k) % 2 = 0 then try_cast({digits}[k] as int) else try_cast({digits}[k] as int) * 2 - case when try_cast({digits}[k] as int) > 4 then 9 else 0 end end for k in range(1, len({digits}) + 1)]) % 10 = 0"
    bare = "replace(m, ' ', '')"
    moved = f"({bare}[5:] || {bare}[:4])"
    # letters written out as two digits, then the remainder digit by digit
    numeral = f"array_to_string([case when {moved}[k] between '0' and '9' then {moved}[k] else (ascii({moved}[k]) - 55)::varchar end for k in range(1, len({moved}) + 1)], '')"
    account = f"list_reduce([try_cast({numeral}[k] as int) for k in range(1, len({numeral}) + 1)], lambda s, x: (s * 10 + x) % 97, 0) = 1"
    edge = lambda cls: f"not regexp_matches(right(piece, 1), '{cls}') and not regexp_matches(left(after, 1), '{cls}')"
    octets = "list_bool_and([len(ltrim(x, '0')) <= 3 and try_cast('0' || right(ltrim(x, '0'), 3) as int) <= 255 for x in string_split(m, '.')])"
    checks = {
        "email": "true",
        "ip": octets,
        "card": f"len({digits}) between 16 and 19 and {luhn_sql}",
        "phone": f"len({digits}) between 8 and 15",
        "iban": f"len({bare}) between 15 and 34 and {account} and {edge('[A-Za-z0-9]')}",
        "ssn": f"left(m, 3) not in ('000', '666') and left(m, 1) <> '9' and m[5:6] <> '00' and right(m, 4) <> '0000' and {edge('[0-9-]')}",
        "shortcard": f"len({digits}) between 13 and 15 and {luhn_sql} and {edge('[A-Za-z0-9+.]')}",
    }
    groups = {"shortcard": "card"}
    near = f"regexp_matches(lower(right(piece, {BEFORE}) || chr(10) || left(after, {AFTER})), '{{}}')"
    rows = " union all ".join(
        f"select id, {n} ord, '{k.name}' kind, s, e, {k.score} + case when {near.format(k.words)} then {k.near} else 0 end score, {k.base} base from pos where m is not null and grp = '{groups.get(k.name, k.name)}' and {checks[k.name]}"
        for n, k in enumerate(KINDS)
    )
    base = [k.name for k in KINDS if k.base]
    line = "string_agg(kind || ':' || s || ':' || e, ',' order by ord, s)"
    return f"""with d as (select row_number() over () id, doc_id, coalesce(text, '') t from documents), f as ({found}),
    pos as (select *, lead(piece) over (partition by id, grp order by i) after, sum(len(piece) + coalesce(len(m), 0)) over (partition by id, grp order by i) e, sum(len(piece) + coalesce(len(m), 0)) over (partition by id, grp order by i) - len(m) s from f),
    r as (select * from ({rows}) where base or score >= {THRESHOLD}),
    g as (select id, {', '.join(f"count(*) filter (kind = '{k}') n_{k}" for k in base)}, coalesce({line} filter (base), '') bs, {line} spans, max(score) top from r group by 1)
    select doc_id, {', '.join(f"coalesce(n_{k}, 0) n_{k}" for k in base)}, sha256(coalesce(bs, '')) base_sha256, coalesce(spans, '') spans, top::bigint top_score from d left join g using (id)"""


SQL = _sql()
