"""DuckDB SQL of the registered queries, written apart from the operators."""

WORDS = r"regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^$', ''), '[^\x20\x09-\x0D]+')"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE [array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(node, lo) AS (SELECT doc_id, doc_id FROM w UNION SELECT edge.y, reach.lo FROM reach JOIN edge ON edge.x = reach.node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.lo) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.node = w.doc_id GROUP BY 1, 2"""

NOTICES = """(VALUES
 (1, 'mit', 'released under the mit license', 'under the mit license', NULL), (2, 'apache-2', 'licensed under the apache license version 2 0', 'apache license version 2', NULL),
 (3, 'cc-by-nc', 'licensed under cc by nc 4 0', 'cc by nc', NULL), (4, 'gpl-3', 'this work is licensed under the gnu general public license version 3', 'gnu general public license version 3', NULL),
 (5, 'lgpl-3', 'licensed under the gnu lesser general public license version 3', 'gnu lesser general public license version 3', NULL),
 (6, 'mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software the software is provided as is', 'permission is hereby granted free of charge', 'the software is provided as is'),
 (7, 'bsd', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', 'redistribution and use in source and binary forms', 'following conditions are met'),
 (8, 'isc', 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted', 'distribute this software for any purpose with or without fee is hereby granted', NULL),
 (9, 'mpl-2', 'this source code form is subject to the terms of the mozilla public license v 2 0', 'terms of the mozilla public license v 2', NULL),
 (10, 'unlicense', 'this is free and unencumbered software released into the public domain', 'free and unencumbered software released into the public domain', NULL),
 (11, 'cc-by', 'licensed under a creative commons attribution 4 0 international license', 'creative commons attribution 4 0', NULL),
 (12, 'cc-by-sa', 'licensed under a creative commons attribution sharealike 4 0 international license', 'creative commons attribution sharealike 4', NULL)) AS v(t, label, notice, k1, k2)"""

LICENSES = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
tpl AS (SELECT *, string_split(notice, ' ') AS nw FROM {NOTICES}),
tw AS (SELECT t, unnest(nw) AS w, unnest(range(len(nw))) AS pos FROM tpl),
seen AS (SELECT DISTINCT doc_id, unnest(ws) AS w FROM d),
idf AS (SELECT v.w, ln((1 + (SELECT count(*) FROM d)) / (1.0 + count(seen.doc_id))) AS idf FROM (SELECT DISTINCT w FROM tw) v LEFT JOIN seen ON seen.w = v.w GROUP BY 1),
top AS (SELECT t, w, pos, idf FROM tw JOIN idf USING (w) QUALIFY row_number() OVER (PARTITION BY t ORDER BY idf DESC, pos) <= 8),
keys AS (SELECT t, label, notice, 1 AS k, k1 AS phrase FROM tpl UNION ALL SELECT t, label, notice, 2, k2 FROM tpl WHERE k2 IS NOT NULL),
met AS (SELECT doc_id, ws, t, label, k, phrase, len(string_split(left(notice, strpos(' ' || notice || ' ', ' ' || phrase || ' ')), ' ')) - 1 AS shift,
          unnest(list_filter(range(len(ws)), lambda i: array_to_string(ws[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase)) AS s
        FROM d JOIN keys ON contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' ')),
have AS (SELECT doc_id, t, label FROM met GROUP BY 1, 2, 3 HAVING count(DISTINCT k) = (SELECT count(*) FROM keys WHERE keys.t = met.t)),
part AS (SELECT met.doc_id, met.t, met.s, sum(CASE WHEN met.ws[met.s - met.shift + top.pos + 1] = top.w AND met.s - met.shift + top.pos >= 0 THEN top.idf ELSE 0 END) / sum(top.idf) AS share
         FROM met JOIN have ON have.doc_id = met.doc_id AND have.t = met.t JOIN top ON top.t = met.t WHERE met.k = 1 GROUP BY 1, 2, 3),
base AS (SELECT doc_id, count(*) AS n, min(s) AS lo, max(s) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM met WHERE t <= 3 GROUP BY 1),
lab AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM have GROUP BY 1),
best AS (SELECT doc_id, max(share) AS score FROM part GROUP BY 1)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(base.n, 0) AS n_base, base.lo AS first_word, base.hi AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(lab.labels, '') AS labels, round(coalesce(best.score, 0.0), 6) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN lab USING (doc_id) LEFT JOIN best USING (doc_id)"""

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest([ws[k:k+4] FOR k IN range(1, len(ws) - 3)]) AS gram FROM d WHERE len(ws) >= 5),
rep AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM rep, (SELECT unnest(range(5)) AS o) GROUP BY 1),
s AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(x, '[^!]', '', 'g')) AS n_exclaims, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(x, '[^A-Za-z]', '', 'g')) AS n_letters
      FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 4 * n_dup_lines > 3 * n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 5 * n_exclaims > n_words OR 2 * n_upper > n_letters) AS kept
FROM s"""

# turns and mask straight from the rows; only the length needs the template's rule for control strings
CHATS = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|BODY\])', '\1\\\2\3', 'g')) AS n,
        CASE role WHEN 'system' THEN 8 + 11 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 4 + 5
          ELSE 7 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|BODY\])', '\1\\\2\3', 'g')) + 8 + 8 END AS marks FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n + marks)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def codes_sql(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Lloyd rounds unrolled: every part against every entry, each round from the one before."""
    ctes = [
        "q AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, label, j, v[j * (len(v) // {parts}) + 1 : (j + 1) * (len(v) // {parts})] AS v FROM q, (SELECT unnest(range({parts})) AS j))",
        f"c0 AS (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, v FROM p QUALIFY e < {entries})",
    ]
    for k in range(rounds + 1):
        ctes.append(
            f"a{k} AS (SELECT p.vec_id, p.label, p.j, p.v, c.e, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{k} c ON c.j = p.j"
            " QUALIFY row_number() OVER (PARTITION BY p.vec_id, p.j ORDER BY d, c.e) = 1)")
        if k < rounds:
            ctes += [
                f"u{k} AS (SELECT j, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{k})",
                f"s{k} AS (SELECT j, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM u{k} GROUP BY ALL)",
                f"m{k} AS (SELECT j, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{k} GROUP BY ALL)",
                f"c{k + 1} AS (SELECT c.j, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (j, e))",
            ]
    ctes.append(f"r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY j) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY ALL)")
    book = f"(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY j, e)) FROM c{rounds})"
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, {book} AS codebooks_sha256 FROM r"


CODES = codes_sql()
