"""SQL of the trie and the manifest, spelled out level by level for DuckDB."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned crc32 of a text of ASCII characters."""
    bit = "xor(b >> 1, (b & 1) * 3988292384)"
    byte = f"list_reduce(list_prepend(xor(a, x), range(8)), lambda b, i: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: {byte}), 4294967295)"


TRIE = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (SELECT conv_id, turns, {crc32("conv_id::VARCHAR")} % 6 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, h), list_slice(c.turns, h + 1, len(c.turns))) AS turns
  FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
seen AS (SELECT conv_id, d, list_slice(turns, 1, d) AS path, len(turns) = d AS ends FROM rebuilt, unnest(range(0, len(turns) + 1)) AS t(d)),
nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM seen GROUP BY path, d),
own_figures AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE length(n.path[n.depth].text) END AS saved
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = list_slice(n.path, 1, n.depth - 1)),
kids AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM own_figures WHERE depth > 0 GROUP BY ALL),
full_figures AS (SELECT f.*, coalesce(n_children, 0) AS n_children FROM own_figures f LEFT JOIN kids USING (depth, conv_id)),
rolled AS (
  SELECT list_slice(path, 1, a) AS path, a AS depth, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM full_figures, unnest(range(0, depth + 1)) AS t(a) GROUP BY ALL)
SELECT conv_id, f.depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM full_figures f JOIN rolled r ON f.depth = r.depth AND f.path = r.path
"""


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs {name}0 ..: (tree, place, size, digest) of each level; {name}s0 ..: (tree, place, lft, rgt), what a fold adds."""
    parts = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        parts.append(
            f"{name}s{k} AS (SELECT a.tree, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS lft, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS rgt"
            f" FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.place // 3 = b.place // 3 WHERE a.size > 1 GROUP BY a.tree, a.place)"
        )
        parts.append(f"{name}{k + 1} AS (SELECT tree, place // 3 AS place, (size + 2) // 3 AS size, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {name}{k} WHERE size > 1 GROUP BY tree, place // 3, size)")
    return ",\n".join(parts)


def _folds(name: str, source: str, levels: int) -> str:
    parts = [f"{name}f0 AS ({source})"]
    for k in range(levels):
        parts.append(
            f"{name}f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN s.tree IS NULL THEN f.digest ELSE sha256(lft || f.digest || rgt) END AS digest, f.siblings || coalesce(lft || rgt, '') AS siblings)"
            f" FROM {name}f{k} f LEFT JOIN {name}s{k} s ON s.tree = f.tree AND s.place = f.place // {3**k})"
        )
    return ",\n".join(parts)


def _leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


def manifest(levels: int = 12, source_levels: int = 7) -> str:
    """For up to 3 ** levels rows a source and 3 ** source_levels sources."""
    roots = " UNION ALL ".join(f"SELECT tree, digest FROM t{k} WHERE size = 1" for k in range(levels + 1))
    root = " UNION ALL ".join(f"SELECT digest FROM r{k} WHERE size = 1" for k in range(source_levels + 1))
    other = "replace(text, chr(10), '')"
    return f"""
WITH hashed AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {crc32("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 THEN {_leaf(other)} ELSE {_leaf("text")} END AS tampered FROM documents),
placed AS (
  SELECT *, row_number() OVER () AS r, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size
  FROM hashed),
{_tree("t", "SELECT tree, place, size, leaf AS digest FROM placed", levels)},
roots AS ({roots}),
{_tree("r", "SELECT 0 AS tree, tree - 1 AS place, count(*) OVER () AS size, digest FROM roots", source_levels)},
root AS ({root}),
{_folds("t", "SELECT r, tree, place, doc_id, leaf, tampered AS digest, '' AS siblings FROM placed", levels)},
{_folds("r", f"SELECT r, tree AS source_no, 0 AS tree, tree - 1 AS place, doc_id, leaf, digest, siblings FROM tf{levels}", source_levels)}
SELECT doc_id, leaf, roots.digest AS subroot, root.digest AS root, sha256(siblings) AS proof_sha256, f.digest AS folded_root, f.digest = root.digest AS verified
FROM rf{source_levels} f JOIN roots ON roots.tree = f.source_no, root
"""
