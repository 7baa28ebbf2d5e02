"""SQL twins, for DuckDB, of the corpus queries that SQL can express."""

from __future__ import annotations

#: crc32 of text as unsigned, by a table that is made from the polynomial; DuckDB has no function for it.
_CRC = """
bits AS (SELECT b, 0 AS k, b::BIGINT AS v FROM range(256) t(b)
    UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8)"""


def _crc(rows: str, columns: str, text: str) -> str:
    """Select ``columns`` and ``crc`` of ``text`` from ``rows``; by single bytes, all rows at once."""
    return f"""SELECT {columns}, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))::BIGINT),
        lambda i: ('0x' || hex({text})[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295) AS crc FROM {rows}, crc_table"""


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELDS = [_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
_LEAF = " || ".join(_FIELDS)
_TAMPERED = " || ".join([*_FIELDS[:-1], _FIELD.format(_LOWER.format("text"))])


def merkle(fanout: int = 16, tamper_one_in: int = 5) -> str:
    """The tree by recursion over levels, first of the sources, then of their subroots; proofs and folds by recursion over rows."""

    def tree(name: str, leaves: str) -> str:
        return f"""{name} AS (SELECT grp, 0 AS level, idx, hash, count(*) OVER (PARTITION BY grp) AS size FROM {leaves}
    UNION ALL SELECT DISTINCT grp, level + 1, idx // {fanout}, sha256(string_agg(hash, '' ORDER BY idx) OVER (PARTITION BY grp, idx // {fanout} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        (size + {fanout - 1}) // {fanout} FROM {name} WHERE size > 1)"""

    def sides(name: str) -> str:
        around = f"(PARTITION BY grp, level, idx // {fanout} ORDER BY idx ROWS BETWEEN"
        return f"""{name}_sides AS (SELECT *, coalesce(string_agg(hash, '') OVER {around} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(hash, '') OVER {around} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name})"""

    def climb(name: str, over: str, start: str) -> str:
        return f"""{name} AS ({start}
    UNION ALL SELECT w.row, w.grp, w.level + 1, w.idx // {fanout}, w.proof || s.l || s.r, sha256(s.l || w.fold || s.r)
        FROM {name} w JOIN {over}_sides s ON s.grp = w.grp AND s.level = w.level AND s.idx = w.idx WHERE s.size > 1)"""

    return f"""WITH RECURSIVE {_CRC},
hashed AS ({_crc("documents", f"doc_id, coalesce('s' || source, '') AS grp, sha256({_LEAF}) AS hash, sha256({_TAMPERED}) AS tampered", "coalesce(doc_id::VARCHAR, '')")}),
leaves AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx FROM hashed),
{tree("low", "leaves")}, {sides("low")},
subroots AS (SELECT grp AS source, 0 AS grp, hash, row_number() OVER (ORDER BY grp) - 1 AS idx FROM low WHERE size = 1),
{tree("high", "subroots")}, {sides("high")},
{climb("up", "low", f"SELECT row, grp, 0 AS level, idx, '' AS proof, CASE WHEN doc_id IS NOT NULL AND crc % {tamper_one_in} = 0 THEN tampered ELSE hash END AS fold FROM leaves")},
topped AS (SELECT row, s.grp, 0 AS level, s.idx, proof, fold FROM up JOIN (SELECT grp AS source, level FROM low WHERE size = 1) t ON t.source = up.grp AND t.level = up.level JOIN subroots s ON s.source = up.grp),
{climb("over", "high", "SELECT * FROM topped")},
ended AS (SELECT row, proof, fold, h.hash AS root FROM over JOIN high h ON h.level = over.level WHERE h.size = 1)
SELECT doc_id, l.hash AS leaf, s.hash AS subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM leaves l JOIN subroots s ON s.source = l.grp JOIN ended USING (row)"""


def spelling(min_chars: int = 6, min_count: int = 5, factor: int = 5, delete_one_in: int = 199) -> str:
    """Near words by what is left without one letter at one place, instead of sums of powers."""
    return f"""WITH RECURSIVE {_CRC},
raw AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS n FROM raw WHERE length(run) >= {min_chars} GROUP BY ALL),
hashed AS ({_crc("runs", "run, n", "id || ':' || run")}),
cut AS (SELECT CASE WHEN crc % {delete_one_in} = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {min_chars} GROUP BY word HAVING sum(n) >= {min_count}),
less AS (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) u(p)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT DISTINCT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS first FROM near GROUP BY word),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {factor} * w.n THEN first END AS form, CASE WHEN most >= {factor} * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM known UNION ALL SELECT c.word, k.form FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM known JOIN ends USING (word)"""
