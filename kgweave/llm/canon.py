"""Mapping freely typed values to a reference list (problem 4), in SQL only.

Partition-based pigeonhole join: a reference string allowed k slips, each an edit or an exchange
of neighbours, is cut into k + 1 segments, one of which any string within k slips holds unchanged
and near its place.  An exchange across a cut would spoil two segments, so the cuts are made at
k + 1 alignments, each a place further: of k slips at least one alignment has none on a cut.  So
typed values meet all their candidates by equality of positional substrings; the built-in
levenshtein verifies them, and an anti-join reports what is left unmatched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.runtime import checkpoint

# What is typed around a name, by kind, and spellings that mean the same.
NOISE = {
    "drug": r"\\([^)]*\\)|\\b\\d+([.,]\\d+)? ?(mg/ml|mg|mcg|ug|g|ml|iu)\\b|\\bxr( \\d+)?\\b|\\b(tabs?|tablets?|caps|inj|once daily|twice daily|po|bid|tid|hcl)\\b",
    "phenotype": r"\\([^)]*\\)|\\bsince [a-z]+\\b|\\bx ?\\d+( (days|weeks|months))?\\b|\\bc/o\\b|\\br/o\\b|\\bh/o\\b|\\bhx( of)?\\b|\\bpossible\\b|\\bmild\\b|\\bknown\\b|\\bpt has\\b|, *stable\\b",
    "disease": r"\\([^)]*\\)|\\bsince [a-z]+\\b|\\bx ?\\d+( (days|weeks|months))?\\b|\\bc/o\\b|\\br/o\\b|\\bh/o\\b|\\bhx( of)?\\b|\\bpossible\\b|\\bmild\\b|\\bknown\\b|\\bpt has\\b|, *stable\\b",
}
SPELLINGS = [("generaliz", "generalis"), ("hemorrhag", "haemorrhag"), ("ischemi", "ischaemi"), ("anemi", "anaemi"), ("edema", "oedema"), ("discolor", "discolour"), ("paresthesi", "paraesthesi")]
_ACCENTS = ("áàâäãåāéèêëēíìîïīóòôöõøōúùûüūýÿñçš", "aaaaaaaeeeeeiiiiiooooooouuuuuyyncs")


def _form(kind: str, value: str) -> str:
    """SQL of a value's plain form: lower case, no accents, noise off, numbers of types in digits, commas kept."""
    x = rf"trim(regexp_replace(regexp_replace(translate(lower({value}), '{_ACCENTS[0]}', '{_ACCENTS[1]}'), '\\p{{M}}', ''), '(?U)[\\s_]+', ' '))"
    x = f"regexp_replace({x}, '{NOISE[kind]}', ' ')"
    if kind == "disease":
        for roman, digit in (("iv", 4), ("iii", 3), ("ii", 2), ("i", 1)):
            x = rf"regexp_replace({x}, '\\btyp[e.]*[ -]*{roman}\\b', 'type {digit}')"
        x = rf"regexp_replace({x}, '\\bt(yp[e.]*)?[ .-]*(\\d+)\\b', 'type $2')"
    return rf"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9,-]+', ' '), ' *,[ ,]*', ','))"


def _spelled(words: str) -> str:
    """SQL of an array: the words as they are, and with other spellings of the first, the rest, and all of SPELLINGS."""
    a, b = SPELLINGS[0]
    first, rest = f"replace({words}, '{a}', '{b}')", words
    for x, y in SPELLINGS[1:]:
        rest = f"replace({rest}, '{x}', '{y}')"
    return f"array_distinct(array({words}, {first}, {rest}, {rest.replace(words, first)}))"


def _forms(column: str) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {_form(k, column)}" for k in NOISE) + " END"


def _slips(size: str) -> str:
    """SQL of k, the slips allowed, by length of the reference string without blanks: one slip needs six letters, two need twelve."""
    return f"CASE WHEN {size} < 6 THEN 0 WHEN {size} < 12 THEN 1 ELSE 2 END"


def _cut(part: str) -> str:
    """SQL of where segment ``part`` begins: even parts, moved on by the alignment; the ends stay."""
    return f"CASE WHEN {part} = 0 THEN 0 WHEN {part} > slips THEN size ELSE CAST(floor(size * {part} / (slips + 1)) AS INT) + align - CAST(floor(slips / 2) AS INT) END"


#: SQL: whether key is near enough to ref_key.  The bounded distance rules out nearly all pairs; an exchange costs it two, but leaves the letters the same.
_NEAR = """CASE levenshtein(key, ref_key, 4) WHEN -1 THEN FALSE WHEN 0 THEN TRUE WHEN 1 THEN TRUE
  WHEN 2 THEN slips > 1 OR {letters} WHEN 3 THEN slips > 1 AND levenshtein({a}, {b}, 2) >= 0 ELSE slips > 1 AND {letters} END""".replace("{letters}", "{a} = {b}").format(
    a="array_join(array_sort(split(key, '')), '')", b="array_join(array_sort(split(ref_key, '')), '')"
)


def map_terms(spark: SparkSession, typed: DataFrame, reference: DataFrame, *, broadcast_rows: int = 200_000, salts: int = 16) -> DataFrame:
    """Typed values (kind, value) with the entry each names: (kind, value, term_id, distance).

    ``reference``: (term_id, kind, name, synonyms).  Each distinct value comes out once; term_id is null where no
    entry of its kind is near enough, and null or blank values don't come out.  Of several entries the
    nearest wins, of equally near ones the smallest term_id.  Near enough: two slips, each an edit or an exchange of neighbours,
    in a name or phrase of twelve letters or more, one slip in one of six or more, none in a shorter one or in a code of up to nine with digits;
    digits of the entry must be equal.  Every pair within these slips is found.  Phrases are also tried with the part after a
    comma put first and with their words in reverse.  An empty reference leaves every value unmatched.
    """
    n = uuid.uuid4().hex[:8]

    def view(name: str, sql: str, keep: bool = False) -> DataFrame:
        df = spark.sql(sql)
        df = checkpoint(df) if keep else df
        df.createOrReplaceTempView(f"{name}_{n}")
        return df

    typed.select("kind", "value").createOrReplaceTempView(f"typed_{n}")
    reference.select("term_id", "kind", "name", "synonyms").createOrReplaceTempView(f"reference_{n}")
    kinds = ", ".join(f"'{k}'" for k in NOISE)
    view("values", f"SELECT DISTINCT kind, value FROM typed_{n} WHERE kind IN ({kinds}) AND NOT value RLIKE '^(?U)\\\\s*$'", keep=True)
    view("names", f"""
        SELECT DISTINCT term_id, kind, replace(words, ' ', '') AS key
        FROM (SELECT term_id, kind, explode(IF(kind = 'drug', array(words), {_spelled('words')})) AS words FROM (
              SELECT term_id, kind, regexp_replace({_forms('raw')}, '[,-]', ' ') AS words FROM (SELECT term_id, kind, explode(concat(array(name), coalesce(synonyms, array()))) AS raw FROM reference_{n} WHERE kind IN ({kinds}))))
        WHERE words <> ''""", keep=True)
    view("forms", f"""
        SELECT DISTINCT kind, value, regexp_replace(words, '[ ,-]', '') AS key
        FROM (SELECT kind, value, explode(IF(kind = 'drug', array(form), array(
                form, array_join(reverse(split(form, ',')), ' '), array_join(reverse(split(form, '[ ,]')), ' '), array_join(reverse(split(form, '[ ,-]')), ' ')))) AS words
              FROM (SELECT kind, value, trim(BOTH ',' FROM {_forms('value')}) AS form FROM values_{n}))
        WHERE words <> ''""", keep=True)
    view("exact", f"SELECT f.kind, f.value, min(r.term_id) AS term_id, 0 AS distance FROM forms_{n} f JOIN names_{n} r ON f.kind = r.kind AND f.key = r.key GROUP BY f.kind, f.value", keep=True)
    view("open", f"SELECT f.* FROM forms_{n} f LEFT ANTI JOIN exact_{n} e ON f.kind = e.kind AND f.value = e.value")
    segments = view("segments", f"""
        SELECT kind, key AS ref_key, regexp_replace(key, '[^0-9]', '') AS digits, size, slips, align, part, substring(key, 1 + {_cut('part')}, {_cut('(part + 1)')} - {_cut('part')}) AS piece
        FROM (SELECT *, {_slips('size')} AS slips FROM (SELECT DISTINCT kind, key, length(key) AS size FROM names_{n}))
        LATERAL VIEW explode(sequence(0, slips)) a AS align LATERAL VIEW explode(sequence(0, slips)) x AS part
        WHERE slips > 0 AND NOT (key RLIKE '[0-9]' AND size <= 9)""", keep=True)
    few = segments.limit(broadcast_rows + 1).count() <= broadcast_rows
    # With m the typed length: ins - del = m - size and ins + del <= slips, so a segment moves by between -(slips - (m - size)) / 2 and (slips + (m - size)) / 2 places.
    view("probes", f"""
        SELECT kind, key, regexp_replace(key, '[^0-9]', '') AS digits, size, align, part, substring(key, 1 + {_cut('part')} + shift, {_cut('(part + 1)')} - {_cut('part')}) AS piece
        FROM (SELECT *, {_slips('size')} AS slips FROM (SELECT kind, key, explode(sequence(length(key) - 2, length(key) + 2)) AS size FROM (SELECT DISTINCT kind, key FROM open_{n} WHERE length(key) >= 5)))
        LATERAL VIEW explode(sequence(0, slips)) a AS align LATERAL VIEW explode(sequence(0, slips)) p AS part
        LATERAL VIEW explode(IF(abs(length(key) - size) <= slips, sequence(CAST(-floor((slips - (length(key) - size)) / 2) AS INT), CAST(floor((slips + (length(key) - size)) / 2) AS INT)), array())) h AS shift
        WHERE slips > 0 AND {_cut('part')} + shift >= 0 AND {_cut('(part + 1)')} + shift <= length(key)""")
    # A long reference isn't broadcast: it is repeated for each salt, so that no frequent piece is one task's work.
    hint, salt = ("/*+ BROADCAST(r) */", "") if few else ("", "AND pmod(xxhash64(p.key), {s}) = r.salt".format(s=salts))
    if not few:
        view("segments", f"SELECT *, explode(sequence(0, {salts - 1})) AS salt FROM segments_{n}")
    view("near", f"""
        SELECT kind, key, ref_key, min(levenshtein(key, ref_key, 4)) AS distance FROM (
          SELECT {hint} p.kind, p.key, r.ref_key, r.slips
          FROM probes_{n} p JOIN segments_{n} r ON p.kind = r.kind AND p.size = r.size AND p.align = r.align AND p.part = r.part AND p.piece = r.piece AND (r.digits = '' OR r.digits = p.digits) {salt})
        WHERE {_NEAR} GROUP BY kind, key, ref_key""", keep=True)
    view("found", f"SELECT o.kind, o.value, r.term_id, e.distance FROM near_{n} e JOIN open_{n} o ON o.kind = e.kind AND o.key = e.key JOIN names_{n} r ON r.kind = e.kind AND r.key = e.ref_key")
    view("matched", f"SELECT kind, value, term_id, distance FROM exact_{n} UNION ALL SELECT kind, value, min(struct(distance, term_id)).term_id, min(distance) FROM found_{n} GROUP BY kind, value", keep=True)
    return spark.sql(f"""
        SELECT kind, value, term_id, distance FROM matched_{n}
        UNION ALL
        SELECT v.kind, v.value, NULL, NULL FROM values_{n} v LEFT ANTI JOIN matched_{n} m ON v.kind = m.kind AND v.value = m.value""")


def resolve(spark: SparkSession, rows: DataFrame, mapped: DataFrame, *, salts: int = 32, heavy_rows: int = 100_000) -> DataFrame:
    """Rows (…, kind, value) with their value's term_id, '' where unmatched.

    Rows of hot values are salted: values that hold more than ``heavy_rows`` rows and a 512th of all, so fewer than 512."""
    n = uuid.uuid4().hex[:8]
    for name, df in (("rows", rows), ("mapped", mapped)):
        df.createOrReplaceTempView(f"{name}_{n}")
    heavy = checkpoint(spark.sql(f"SELECT kind, value, count(*) AS n FROM rows_{n} GROUP BY kind, value HAVING count(*) > {heavy_rows}"))
    least = rows.count() / 512 if heavy.take(1) else 0
    heavy.createOrReplaceTempView(f"heavy_{n}")
    spark.sql(f"SELECT kind, value FROM heavy_{n} WHERE n > {least}").createOrReplaceTempView(f"hot_{n}")
    cols = ", ".join(f"r.`{c}`" for c in rows.columns)
    return spark.sql(f"""
        WITH salted AS (SELECT /*+ BROADCAST(h) */ {cols}, IF(h.value IS NULL, 0, CAST(pmod(xxhash64({cols}), {salts}) AS INT)) AS salt FROM rows_{n} r LEFT JOIN hot_{n} h ON h.kind = r.kind AND h.value = r.value),
        repeated AS (SELECT /*+ BROADCAST(h) */ m.kind, m.value, m.term_id, explode(IF(h.value IS NULL, array(0), sequence(0, {salts - 1}))) AS salt FROM mapped_{n} m LEFT JOIN hot_{n} h ON h.kind = m.kind AND h.value = m.value)
        SELECT {cols}, coalesce(m.term_id, '') AS term_id FROM salted r JOIN repeated m ON m.kind = r.kind AND m.value = r.value AND m.salt = r.salt""")
