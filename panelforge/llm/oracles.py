"""DuckDB SQL of the longer queries, written out level by level."""

from __future__ import annotations

from panelforge.llm import licenses


def crc32(value: str) -> str:
    """Unsigned CRC-32 of a value's decimal text (null: empty), a bit at a time."""
    text = f"coalesce(({value})::VARCHAR, '')"
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii({text}[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"


def merkle_manifest(fanout: int = 16, levels: int = 5) -> str:
    """Trees of up to ``fanout ** levels`` leaves and as many sources."""
    fields = ["doc_id", "source", "lang", "n_chars", "{text}"]
    each = " || ".join(f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || {c}, '-')" for c in fields)
    lowered = "CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    steps = [
        f"d AS (SELECT *, {crc32('doc_id')} AS crc FROM documents)",
        f"h AS (SELECT coalesce('s' || source, '') AS tree, doc_id, sha256({each.format(text='text')}) AS leaf, sha256({each.format(text=lowered)}) AS changed FROM d)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, leaf AS h FROM h)",
    ]
    for name, lowest in (("a", "a0"), ("t", "t0")):
        if name == "t":
            tops = " UNION ALL ".join(f"SELECT tree, h FROM a{k} WHERE n = 1" for k in range(levels))
            steps.append(f"s AS ({tops})")
            steps.append("t0 AS (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h FROM s)")
        for k in range(levels - 1):
            steps.append(f"{name}r{k} AS (SELECT tree, i // {fanout} AS run, list(h ORDER BY i) AS l FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
            steps.append(f"{name}{k + 1} AS (SELECT r.tree, run AS i, count(*) OVER (PARTITION BY r.tree) AS n, sha256(array_to_string(l, '')) AS h FROM {name}r{k} r)")
    steps.append("root AS (" + " UNION ALL ".join(f"SELECT h FROM t{k} WHERE n = 1" for k in range(levels)) + ")")
    # Each leaf with its run at every level of both trees; a level above the top has none.
    sides, joins, at = [], [], 0
    for name, row in (("a", "a0"), ("t", "t0")):
        for k in range(levels - 1):
            run, slot = f"({row}.i // {fanout ** (k + 1)})", f"({row}.i // {fanout**k} % {fanout})"
            joins.append(f"LEFT JOIN {name}r{k} x{at} ON x{at}.tree = {row}.tree AND x{at}.run = {run}")
            sides.append(f"array_to_string(x{at}.l[1:{slot}], '') AS b{at}, array_to_string(x{at}.l[{slot} + 2:], '') AS e{at}, x{at}.l IS NOT NULL AS on{at}")
            at += 1
    steps.append(
        f"p AS (SELECT a0.doc_id, a0.leaf, a0.changed, t0.h AS subroot, root.h AS root, {', '.join(sides)} FROM a0 JOIN t0 ON t0.source = a0.tree CROSS JOIN root {' '.join(joins)})"
    )
    last = "p"
    for k in range(at):
        node = "changed" if k == 0 else f"f{k - 1}"
        steps.append(f"q{k} AS (SELECT *, CASE WHEN on{k} THEN sha256(coalesce(b{k}, '') || {node} || coalesce(e{k}, '')) ELSE {node} END AS f{k} FROM {last})")
        last = f"q{k}"
    proof = " || ".join(f"CASE WHEN on{k} THEN coalesce(b{k}, '') || coalesce(e{k}, '') ELSE '' END" for k in range(at))
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f{at - 1} AS folded_root, f{at - 1} = root AS verified FROM {last}"


def license_scan() -> str:
    """Every window of every width against every template."""
    split = r"list_filter(string_split_regex(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    templates = [(label, " ".join(licenses.plain_words(text))) for label, text in licenses.TEMPLATES]
    values = ", ".join(f"('{label}', '{text}', {max(licenses.LEAST_WIDTH, 1 << (len(text.split()) - 1).bit_length())})" for label, text in templates)

    def places(phrase: str) -> str:
        words = phrase.split()
        here = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
        return f"list_filter(range(0, greatest(len(w) - {len(words) - 1}, 0)), lambda i: {here})"

    parts = [f"{places(phrase)} AS p{k}" for k, (phrase, _) in enumerate(licenses.PHRASES)]
    every = "list_concat(list_concat(p0, p1), p2)"
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licenses.PHRASES))
    return f"""
WITH t AS (SELECT label, list_distinct(string_split(body, ' ')) AS tw, h FROM (VALUES {values}) v(label, body, h)),
d AS (SELECT row_number() OVER () AS r, doc_id, {split.format(text='text')} AS w FROM documents),
p AS (SELECT r, doc_id, w, {', '.join(parts)} FROM d),
q AS (SELECT r, doc_id, w, len({every}) AS n_base, list_min({every}) AS first_word, list_max({every}) AS last_word, list_filter([{base}], lambda x: x IS NOT NULL) AS bl FROM p),
b AS (SELECT r, h, unnest(list_transform(range(0, len(w), h), lambda s: list_distinct(w[s + 1:s + 2 * h]))) AS bw FROM q, (SELECT DISTINCT h FROM t) WHERE len(w) > 0),
m AS (SELECT r, label, len(list_intersect(bw, tw)) / len(tw) AS c FROM b JOIN t USING (h)),
f AS (SELECT r, list(DISTINCT label) AS ml, max(c) AS c FROM m WHERE c >= {licenses.THRESHOLD} GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, n_base::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(bl), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(ml, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM q LEFT JOIN f USING (r)"""


def conversation_trie() -> str:
    """Each node with all its ancestors, by the turns of its smallest member."""
    return f"""
WITH i AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
  sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS item FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, item) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM i),
c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, {crc32('conv_id')} % 9 AS h FROM o WHERE i = 0),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS len FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, o.i + 1 AS d, o.item, o.bytes, k.len FROM k JOIN o ON o.conv_id = k.base AND o.i < k.taken
  UNION ALL SELECT k.conv_id, k.taken + o.i - k.h + 1, o.item, o.bytes, k.len FROM k JOIN o ON o.conv_id = k.conv_id AND o.i >= k.h),
m AS (SELECT conv_id, d, len, bytes, string_agg(item, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM r
  UNION ALL SELECT conv_id, 0, len, 0, '' FROM k),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
  sha256(coalesce(string_agg(CASE WHEN d = len THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY path, d),
f AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.path[1:64 * (n.d - 1)]),
g AS (SELECT parent_conv_id, d - 1 AS d, count(*) AS n_children FROM f WHERE d > 0 GROUP BY ALL),
x AS (SELECT f.*, coalesce(g.n_children, 0) AS n_children FROM f LEFT JOIN g ON g.parent_conv_id = f.conv_id AND g.d = f.d),
s AS (SELECT m.path, m.d, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved_tokens
  FROM x JOIN m ON m.conv_id = x.conv_id AND m.d <= x.d GROUP BY m.path, m.d)
SELECT x.conv_id::BIGINT AS conv_id, x.d::BIGINT AS depth, x.parent_conv_id::BIGINT AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN s ON s.path = x.path AND s.d = x.d"""
