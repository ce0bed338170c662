"""SQL twins of training-data queries, for DuckDB: checksums and hashes are worked out in whole-number arithmetic."""

from __future__ import annotations

#: Windows as text: a word goes if one over it has a text that started earlier.
REPEATS = r"""
    WITH held AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM held),
    windows AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER o AS s, count(*) OVER o AS n FROM words
      WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
    ranked AS (SELECT doc_id, pos, word, n = 20 AND row_number() OVER (PARTITION BY s, n = 20 ORDER BY doc_id, pos) > 1 AS again FROM windows),
    covered AS (SELECT doc_id, pos, word, coalesce(max(CASE WHEN again THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) >= pos - 19, FALSE) AS gone FROM ranked),
    kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS t FROM covered GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM held LEFT JOIN kept USING (doc_id)
"""


#: The table of CRC-32 by its polynomial; the checksum of a list of bytes b; the bytes of a text.
_CRCS = "crcs AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS book FROM range(0, 256) r(i))"
_CRC = "xor(coalesce(list_reduce({}, lambda c, x: xor(c >> 8, book[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295), 4294967295)"
_BYTES = "list_transform(regexp_extract_all(hex({}), '..'), lambda x: (instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)"
#: Sizes, checksums, and jumps as 128-bit numbers modulo 2**64.
SHARDS = f"""
    WITH RECURSIVE {_CRCS},
    held AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 8 AS size, {_BYTES.format("coalesce(text, '')")} AS b FROM documents),
    sums AS (SELECT doc_id, size, {_CRC.format("b")} AS text_crc32 FROM held, crcs),
    keys AS (SELECT DISTINCT coalesce(doc_id, 0) AS k FROM documents),
    walk AS (SELECT k, ((k::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT AS h, -1::BIGINT AS b, 0::BIGINT AS j, 0 AS small, 0 AS grown FROM keys
      UNION ALL SELECT k, nh, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / (nh // 8589934592 + 1)::DOUBLE))::BIGINT, CASE WHEN j < 24 THEN j ELSE small END, CASE WHEN j < 25 THEN j ELSE grown END
      FROM (SELECT *, (h * 2862933555777941757 + 1) % 18446744073709551616 AS nh FROM walk WHERE j < 25)),
    shards AS (SELECT k, max(small)::INTEGER AS shard, max(grown)::INTEGER AS grown_shard FROM walk GROUP BY k)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard, row_number() OVER (PARTITION BY shard
      ORDER BY ((coalesce(doc_id, 0) % 1024 + 1024) % 1024 + text_crc32 % 1024) % 1024, doc_id NULLS FIRST, text_crc32, size)::BIGINT - 1 AS slot
    FROM sums JOIN shards ON k = coalesce(doc_id, 0)
"""

# The five primes of the 64-bit hash, its rotations, and the query's seed.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_SEED, _WHOLE = 42, 1 << 64


def _number(value: int) -> str:
    return f"{value % _WHOLE}::UHUGEINT"


def _times(x: str, prime: int) -> str:
    return f"(({x}) * {_number(_PRIMES[prime - 1])}) % {_WHOLE}::UHUGEINT"


def _plus(x: str, y: str) -> str:
    return f"(({x}) + ({y})) % {_WHOLE}::UHUGEINT"


def _turned(x: str, bits: int) -> str:
    return f"(({x}) * {_number(1 << bits)} % {_WHOLE}::UHUGEINT + ({x}) // {_number(1 << (64 - bits))})"


def _xor(x: str, y: str) -> str:
    return f"xor(({x})::UBIGINT, ({y})::UBIGINT)::UHUGEINT"


def _folded(x: str, bits: int) -> str:
    return _xor(x, f"({x}) // {_number(1 << bits)}")


def _little_endian(first: str, size: int) -> str:
    """A number of ``size`` bytes of the list b."""
    return f"list_reduce(list_transform(range(0, {size}), lambda j: b[{first} + j + 1]::UHUGEINT * (1::UHUGEINT << (8 * j)::UHUGEINT)), lambda p, q: p + q)"


_ROUND = _times(_turned(_times("x", 2), 31), 1)
_STARTS = ", ".join(str((_SEED + k) % _WHOLE) for k in (_PRIMES[0] + _PRIMES[1], _PRIMES[1], 0, -_PRIMES[0]))
#: (s, h) of shingles(s): the 64-bit hash of their UTF-8 bytes, by stripes of 32, then by 8, by 4 and by 1.
_HASHES = f"""
    bytes AS (SELECT s, octet_length(encode(s)) AS n, {_BYTES.format("s")} AS b FROM shingles),
    eightfold AS (SELECT s, n, b, list_transform(range(0, n // 8), lambda k: {_little_endian("8 * k", 8)}) AS w FROM bytes),
    lanes AS (SELECT *, CASE WHEN n >= 32 THEN 4 * (n // 32) ELSE 0 END AS used, list_transform(range(0, 4), lambda l: list_reduce(list_transform(range(0, n // 32), lambda k: w[4 * k + l + 1]),
      lambda v, x: {_times(_turned(_plus("v", _times("x", 2)), 31), 1)}, CAST([{_STARTS}] AS UHUGEINT[])[l + 1])) AS v FROM eightfold),
    met AS (SELECT *, list_transform(v, lambda x: {_ROUND}) AS m, ({_turned("v[1]", 1)} + {_turned("v[2]", 7)} + {_turned("v[3]", 12)} + {_turned("v[4]", 18)}) % {_WHOLE}::UHUGEINT AS a FROM lanes),
    begun AS (SELECT s, n, b, w, used, {_plus(f"CASE WHEN n >= 32 THEN list_reduce(m, lambda a, x: {_plus(_times(_xor('a', 'x'), 1), _number(_PRIMES[3]))}, a) ELSE {_number(_SEED + _PRIMES[4])} END", "n::UHUGEINT")} AS a FROM met),
    eights AS (SELECT s, n, b, list_reduce(list_transform(w[used + 1:], lambda x: {_ROUND}), lambda a, x: {_plus(_times(_turned(_xor("a", "x"), 27), 1), _number(_PRIMES[3]))}, a) AS a FROM begun),
    fours AS (SELECT s, n, b, CASE WHEN n % 8 >= 4 THEN {_plus(_times(_turned(_xor("a", _times(_little_endian("8 * (n // 8)", 4), 1)), 23), 2), _number(_PRIMES[2]))} ELSE a END AS a FROM eights),
    ones AS (SELECT s, list_reduce(list_transform(b[4 * (n // 4) + 1:], lambda x: {_times("x::UHUGEINT", 5)}), lambda a, x: {_times(_turned(_xor("a", "x"), 11), 1)}, a) AS a FROM fours),
    once AS (SELECT s, {_times(_folded("a", 33), 2)} AS a FROM ones), twice AS (SELECT s, {_times(_folded("a", 29), 3)} AS a FROM once),
    hashes AS (SELECT s, ({_folded("a", 32)})::UBIGINT AS h FROM twice)"""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BITS = " + ".join(f"CASE WHEN 2 * sum((h >> {k}) & 1) > count(*) THEN {1 << k}::UHUGEINT ELSE 0::UHUGEINT END" for k in range(64))
#: Fingerprints of four-word shingles, links at four differing bits or fewer, and the smallest doc_id reached.
NEAR = rf"""
    WITH RECURSIVE held AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    words AS (SELECT doc_id, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM held),
    windows AS (SELECT doc_id, size, pos, string_agg(word, ' ') OVER o AS s, count(*) OVER o AS n FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
    own AS (SELECT doc_id, s FROM windows WHERE n = 4 OR (size < 4 AND pos = 1)), shingles AS (SELECT DISTINCT s FROM own), {_HASHES},
    found AS (SELECT doc_id, ({_BITS})::UBIGINT AS fp FROM own JOIN hashes USING (s) GROUP BY doc_id),
    prints AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM held LEFT JOIN found USING (doc_id)),
    different AS (SELECT fp, min(doc_id) AS first FROM prints GROUP BY fp),
    links AS (SELECT a.fp AS a, b.fp AS b FROM different a JOIN different b ON bit_count(xor(a.fp, b.fp)::HUGEINT) <= 4),
    reach AS (SELECT fp AS a, fp AS b FROM different UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    named AS (SELECT reach.a AS fp, min(first) AS component_id FROM reach JOIN different ON different.fp = reach.b GROUP BY reach.a)
    SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN named USING (fp)
"""
#: The exact nearest; an index that finds them all, as with few vectors, gives the same rows.
NEAREST = """
    WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda k: c.v[k] * q.v[k]), lambda a, b: a + b) AS score
      FROM fine q JOIN fine c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def _grams(x: str, run: str) -> str:
    return f"list_transform(range(1, length({x}) - {run} + 2), lambda k: substr({x}, k, {run}))"


def _alike(x: str, y: str) -> str:
    """Two signatures: equal, without a common run of three (or of the shorter one), or by their edit distance."""
    run = f"least(3, length({x}), length({y}))"
    return f"""CASE WHEN {x} = {y} THEN 1.0::DOUBLE WHEN {run} = 0 OR NOT list_has_any({_grams(x, run)}, {_grams(y, run)}) THEN 0.0::DOUBLE
      ELSE 1.0::DOUBLE - levenshtein({x}, {y})::DOUBLE / greatest(length({x}), length({y})) END"""


def _near(left: str, right: str) -> str:
    """Two fingerprints, by the signatures at sizes that both have."""
    at = lambda when, a, b: f"CASE WHEN {when} THEN {_alike(a, b)} ELSE 0.0::DOUBLE END"
    a, b = f"{left}.size", f"{right}.size"
    return f"""CASE WHEN {left}.print = {right}.print THEN 1.0::DOUBLE ELSE greatest({at(f"{a} = {b}", f"{left}.one", f"{right}.one")}, {at(f"{a} = {b}", f"{left}.two", f"{right}.two")},
      {at(f"{a} = 2 * {b}", f"{left}.one", f"{right}.two")}, {at(f"2 * {a} = {b}", f"{left}.two", f"{right}.one")}) END"""


_LEVELS = 21
_LAGS = [f"lag(x, {k}, 0) OVER o" for k in range(7)]
_ROLLING = f"""({" + ".join(f"{8 - k} * {lag}" for k, lag in enumerate(_LAGS))} + {"xor(" * 6}{_LAGS[0]}::BIGINT{"".join(f", ({lag}::BIGINT << {5 * k}) & 4294967295)" for k, lag in enumerate(_LAGS) if k)}) & 4294967295"""
_CUTS = ", ".join(f"count(*) FILTER (v % {3 << k} = {(3 << k) - 1})" for k in range(_LEVELS))
#: Fingerprints byte by byte: rolling hashes of seven bytes, the block size by the ends it finds, a letter for each piece's checksum.
PIECES = f"""
    WITH {_CRCS},
    ranked AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, count(*) OVER () AS many FROM documents),
    pairs AS (SELECT a.doc_id, a.t, b.t AS after, left(a.t, length(a.t) - length(a.t) // 2) || left(b.t, length(a.t) // 2) AS edited FROM ranked a JOIN ranked b ON b.r = a.r % a.many + 1),
    texts AS (SELECT row_number() OVER () AS id, s, octet_length(encode(s)) AS n FROM (SELECT DISTINCT t AS s FROM pairs UNION SELECT edited FROM pairs)),
    bytes AS (SELECT id, unnest(range(1, n + 1)) AS pos, unnest({_BYTES.format("s")}) AS x FROM texts),
    rolled AS (SELECT id, pos, x, {_ROLLING} AS v FROM bytes WINDOW o AS (PARTITION BY id ORDER BY pos)),
    counted AS (SELECT id, [{_CUTS}] AS c FROM rolled GROUP BY id),
    begun AS (SELECT id, n, coalesce(c, [0::BIGINT]) AS c, list_filter(range(0, {_LEVELS}), lambda k: 192 * (1 << k) >= n)[1] AS k FROM texts LEFT JOIN counted USING (id)),
    raised AS (SELECT id, c, CASE WHEN n = 0 THEN 0 ELSE list_filter(range(k, {_LEVELS}), lambda j: c[j + 1] <= 256)[1] END AS k FROM begun),
    settled AS (SELECT id, 3 * (1 << list_reduce(range(0, {_LEVELS}), lambda j, i: CASE WHEN j > 0 AND c[j + 1] < 32 AND c[j] <= 256 THEN j - 1 ELSE j END, k)) AS size FROM raised),
    cut AS (SELECT id, l AS level, pos, x, sum((v % (size * l) = size * l - 1)::INTEGER) OVER (PARTITION BY id, l ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS piece
      FROM rolled JOIN settled USING (id), (VALUES (1), (2)) levels(l)),
    pieces AS (SELECT id, level, coalesce(piece, 0) AS piece, list(x ORDER BY pos) AS b FROM cut GROUP BY id, level, coalesce(piece, 0)),
    letters AS (SELECT id, level, piece, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', (((({_CRC.format("b")})::UBIGINT * 2654435761) >> 26) & 63)::INTEGER + 1, 1) AS letter FROM pieces, crcs),
    signed AS (SELECT id, string_agg(letter, '' ORDER BY piece) FILTER (WHERE level = 1) AS one, string_agg(letter, '' ORDER BY piece) FILTER (WHERE level = 2) AS two FROM letters GROUP BY id),
    prints AS (SELECT s, size, coalesce(one, '') AS one, coalesce(two, '') AS two, size || ':' || coalesce(one, '') || ':' || coalesce(two, '') AS print
      FROM texts JOIN settled USING (id) LEFT JOIN signed USING (id))
    SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, p.print AS fingerprint, q.print AS edited_fingerprint, {_near("p", "q")} AS near_edited, {_near("p", "z")} AS near_next
    FROM pairs JOIN prints p ON p.s = t JOIN prints q ON q.s = edited JOIN prints z ON z.s = after
"""


# The base patterns.
_KINDS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""".replace("\\'", "\'\'"),
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def _matches(number: int, kind: str, pattern: str) -> str:
    """Matches of a pattern that are long enough, with the places that gaps and matches before them add up to."""
    fine = {"assign": "length(own) >= 8", "access": "length(m) >= 16", "hex": "length(m) >= 32"}[kind]
    own = f"unnest(regexp_extract_all(t, '{pattern}', {2 if kind == 'assign' else 0}))"
    return f"""SELECT doc_id, {number} AS kind_number, '{kind}' AS kind, e - length(m) AS a, e FROM (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS e
      FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m, {own} AS own, unnest(string_split_regex(t, '{pattern}')[:-2]) AS g, generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) AS k FROM held)) WHERE {fine}"""


#: Spans of the base patterns; equal to the query where the battery finds no further secret, as in texts that hide none.
SECRETS = f"""
    WITH held AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({" UNION ALL ".join(_matches(k, *item) for k, item in enumerate(_KINDS.items()))}),
    told AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
      string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, kind_number) AS spans FROM spans GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM held LEFT JOIN told USING (doc_id)
"""
