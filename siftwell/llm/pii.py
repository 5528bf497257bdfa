r"""Personal data in whole texts. SQL functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for IBANs), and words
near a span adjust its score. The texts never leave their row: a text is split at the matches of a
pattern, and the lengths of the gaps and matches give each span's offsets in code points.

The expressions are possessive, and begin only where no match could have begun earlier (or right after
the last match, ``\G``), so that the JVM neither recurses nor tries every tail of a long run. What they
match is what the plain forms match, leftmost and without overlap:

email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``; ip four runs of digits between dots, each at
most 255; card ``[0-9]([\x20-]?[0-9])+`` with 12 to 19 digits that pass Luhn; phone
``\+[0-9][\x20().0-9-]+[0-9]`` with 9 to 15 digits. Added by this operator: iban (country, check digits
and 11 to 30 letters or digits, perhaps spaced, passing mod 97), local_phone (national forms
such as (030) 123-4567 that have a context word near) and ssn (3-2-4 digits, with a context word near).

What follows an IBAN may look like its continuation. Its pattern matches country and check digits only and
looks ahead at what may belong to it; the span ends after the country's number of characters or, for a country
that is not in the list, at the last word end that passes mod 97.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table

#: kind -> (a character, or an expression, that is found wherever the pattern is; pattern). In the order of kinds.
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    # A whole chain of digits with single separators is one match; only chains of 12 to 19 digits count.
    "card": ("[0-9][ -]?[0-9][ -]?[0-9]", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": ("[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))"),
    "local_phone": ("0[0-9]{2}", r"(?<![0-9A-Za-z+(.-])\(?0[0-9]{2,4}\)?[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9A-Za-z])"),
    "ssn": ("-", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed match, what a context word adds, and the words, sought within so many characters on either side.
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.7, 0.3), "iban": (0.9, 0.1), "local_phone": (0.4, 0.4), "ssn": (0.4, 0.5)}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo", "ip": r"\bip\b|host|server|address|login", "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": r"phone|call|tel\b|tel[.:]|mobile|fax|telefon|móvil", "iban": "iban|bank|account|konto|cuenta|compte",
    "local_phone": r"phone|call|tel\b|tel[.:]|mobile|fax|telefon|móvil", "ssn": r"\bssn\b|social security|tax",
}
NEAR = 40
#: Characters that a match has at least; those that an IBAN may have after the match of its pattern, spaces included.
SHORTEST, TAIL = 4, 60
#: Letters and digits of an IBAN by country.
IBAN_LENGTHS = {
    n: countries.split() for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
#: A span is reported from this score on; base spans always are.
LEAST = 0.5
#: Spans are numbered in runs of so many, so that a text with very many stays nearly linear.
RUN = 256


def _found(kind: str) -> Column:
    """Array of (gap, match, tail, before, after) of ``text``: a gap's length, the match that ends it (null after the last gap), what the match looks ahead at, and the gap's last and first characters."""
    has, pattern = PATTERNS[kind]
    m, g = f"regexp_extract_all(text, {_sql(pattern)}, 0)", f"split(text, {_sql(pattern)}, -1)"
    seek = f"contains(text, '{has}')" if len(has) == 1 else f"text rlike {_sql(has)}"
    zipped, tail, after = f"arrays_zip({m}, {g})", "''", NEAR
    if kind == "iban":
        zipped, tail, after = f"arrays_zip({m}, {g}, regexp_extract_all(text, {_sql(pattern)}, 1))", "x['2']", NEAR + TAIL
    return F.expr(f"""
        CASE WHEN {seek} THEN transform(
            {zipped},
            x -> named_struct('gap', length(x['1']), 'match', x['0'], 'tail', {tail}, 'before', right(x['1'], {NEAR}), 'after', left(x['1'], {after})))
        END""")  # fmt: skip


def _sql(text: str) -> str:
    return "r'" + text.replace("'", "\\'") + "'"


def _placed(kind: str) -> str:
    """SQL for the array of (s, i, match, tail) of column ``f_<kind>``; i is the match's place in it."""
    f = f"f_{kind}"
    found, piece = "STRUCT<gap: INT, match: STRING, tail: STRING, before: STRING, after: STRING>", "STRUCT<s: INT, i: INT, match: STRING, tail: STRING>"
    return f"""
        flatten(transform(
            aggregate(
                sequence(0, cast(ceil(size({f}) / {RUN}) AS INT) - 1),
                named_struct('at', 0, 'runs', cast(array() AS ARRAY<STRUCT<at: INT, k: INT, xs: ARRAY<{found}>>>)),
                (acc, k) -> named_struct(
                    'at', acc.at + aggregate(slice({f}, k * {RUN} + 1, {RUN}), 0, (n, x) -> n + x.gap + coalesce(length(x.match), 0)),
                    'runs', concat(acc.runs, array(named_struct('at', acc.at, 'k', k, 'xs', slice({f}, k * {RUN} + 1, {RUN}))))),
                acc -> acc.runs),
            r -> aggregate(
                sequence(0, size(r.xs) - 1),
                named_struct('at', r.at, 'out', cast(array() AS ARRAY<{piece}>)),
                (acc, i) -> named_struct(
                    'at', acc.at + r.xs[i].gap + coalesce(length(r.xs[i].match), 0),
                    'out', CASE WHEN r.xs[i].match IS NULL THEN acc.out ELSE concat(acc.out, array(named_struct(
                        's', acc.at + r.xs[i].gap, 'i', r.k * {RUN} + i + 1, 'match', r.xs[i].match, 'tail', r.xs[i].tail))) END),
                acc -> acc.out)))"""


def _near(kind: str) -> str:
    """SQL: the NEAR characters of the text on either side of the span ``x``, in lower case, from the gaps and matches about it.

    Each is cut to what can count, and so many of them are enough, since no match is shorter than SHORTEST.
    """
    f = f"f_{kind}"
    more = TAIL if kind == "iban" else 0
    first, pieces = f"greatest(1, x.i - {NEAR // SHORTEST})", (NEAR + more) // SHORTEST
    before = f"array_join(transform(slice({f}, {first}, x.i - {first} + 1), (y, j) -> concat(y.before, CASE WHEN j = x.i - {first} THEN '' ELSE right(y.match, {NEAR}) END)), '')"
    after = f"array_join(transform(slice({f}, x.i + 1, {pieces + 1}), y -> concat(y.after, coalesce(left(y.match, {NEAR + more}), ''))), '')"
    beyond = f"substring({after}, length(x.match) - 3, {NEAR})" if more else f"left({after}, {NEAR})"
    return f"lower(concat(right({before}, {NEAR}), ' ', {beyond}))"


def _iban() -> str:
    """SQL: the IBAN that begins with ``x``, or null. What follows ``x`` must not go on as a word."""
    lengths = " ".join(f"WHEN left(x.match, 2) IN ({', '.join(map(repr, of))}) THEN array({n})" for n, of in IBAN_LENGTHS.items())
    cut = "regexp_extract(concat(x.match, x.tail), concat('^(?:[ ]?[A-Z0-9]){', n, '}(?![A-Za-z0-9])'), 0)"
    return f"get(filter(transform(CASE {lengths} ELSE sequence(34, 15, -1) END, n -> {cut}), c -> c <> '' AND {mod97('c', 'd')}), 0)"


def _candidates(kind: str) -> str:
    """SQL for the array of (s, i, match) that are whole spans if they are confirmed; of overlapping IBANs the first."""
    if kind != "iban":
        return _placed(kind)
    whole = f"filter(transform({_placed(kind)}, x -> named_struct('s', x.s, 'i', x.i, 'match', {_iban()})), x -> x.match IS NOT NULL)"
    return f"""
        aggregate(
            {whole}, cast(array() AS ARRAY<STRUCT<s: INT, i: INT, match: STRING>>),
            (acc, x) -> CASE WHEN size(acc) = 0 OR x.s >= acc[size(acc) - 1].s + length(acc[size(acc) - 1].match) THEN concat(acc, array(x)) ELSE acc END)"""


def mod97(text: str, c: str = "c") -> str:
    """SQL: whether the IBAN ``text`` has remainder 1; letters count as 10 to 35, one character at a time, named ``c``."""
    moved = f"concat(substring(replace({text}, ' ', ''), 5), left(replace({text}, ' ', ''), 4))"
    value = f"CASE WHEN {c} BETWEEN '0' AND '9' THEN ascii({c}) - 48 ELSE ascii({c}) - 55 END"
    return f"aggregate(split({moved}, ''), 0, (n, {c}) -> CASE WHEN {c} = '' THEN n ELSE (n * (CASE WHEN {c} BETWEEN '0' AND '9' THEN 10 ELSE 100 END) + {value}) % 97 END) = 1"


def _confirmed(kind: str) -> str:
    digits = "regexp_replace(x.match, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": "forall(split(x.match, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(right(p, 3) AS INT), 0) <= 255)",
        "card": f"luhn_check({digits})",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": "true",
        "local_phone": f"length({digits}) BETWEEN 9 AND 13",
        "ssn": "left(x.match, 3) NOT IN ('000', '666') AND left(x.match, 1) <> '9'",
    }[kind]


def spans(docs: DataFrame) -> DataFrame:
    """``docs`` with spans, an array of (start, rank, kind, end, score) by start and kind; end is exclusive.

    Null and empty texts have no spans; very long ones are searched whole, in time that grows with their length. Repeated
    rows stay, ids play no part, and an empty table stays empty. Other columns of any name pass through; a column
    ``spans`` is replaced.
    """
    whole, unpack = packed(docs, "text")
    d = whole.withColumn("_text", F.col("text")).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumns({f"f_{k}": _found(k) for k in PATTERNS})
    lists = []
    for rank, kind in enumerate(PATTERNS):
        base, more = SCORES[kind]
        lists.append(f"""
            CASE WHEN size(f_{kind}) > 1 THEN filter(transform(
                filter({_candidates(kind)}, x -> {_confirmed(kind)}),
                x -> named_struct('start', x.s, 'rank', {rank}, 'kind', '{kind}', 'end', x.s + length(x.match),
                                  'score', CASE WHEN {_near(kind)} rlike {_sql(CONTEXT[kind])} THEN {base + more}D ELSE {base}D END)),
                x -> {str(kind in BASE).lower()} OR x.score >= {LEAST}D) END""")  # fmt: skip
    empty = "cast(array() AS ARRAY<STRUCT<start: INT, rank: INT, kind: STRING, end: INT, score: DOUBLE>>)"
    out = d.withColumn("spans", F.expr(f"array_sort(flatten(array({', '.join(f'coalesce({x}, {empty})' for x in lists)})))"))
    return unpack(out.withColumn("text", F.col("_text")), "spans")


def joined(of: str) -> str:
    return f"array_join(transform({of}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = f"filter(spans, x -> x.rank < {len(BASE)})"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE),
        F.sha2(F.expr(joined(base)).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined("spans")).alias("spans"),
        F.expr("coalesce(array_max(transform(spans, x -> x.score)), 0D)").alias("top_score"),
    )
