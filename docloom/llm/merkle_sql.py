"""The manifest of ``documents`` in SQL: both trees unrolled level by level."""

from __future__ import annotations

#: Levels of each tree: enough for 16 ** 6 rows of a source and as many sources.
LEVELS = 6


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string: each byte is put in, then eight shifts (-1) follow."""
    steps = f"list_concat([4294967295], flatten(list_transform(range(1, length({text}) + 1), lambda i: list_concat([ascii(substr({text}, i, 1))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]))))"
    return f"xor(4294967295, list_reduce({steps}::BIGINT[], lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"


def leaf(text: str) -> str:
    coded = [f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(coded)})"


def tree(name: str, leaves: str) -> list[str]:
    """``{name}i(g, r, d)``: the nodes of level i, the last one being the root; ``{name}pi``: what lies left and right of each.

    Where a group has one node left it stays as it is and has nothing beside it (null).
    """
    out = [f"{name}0 AS ({leaves})"]
    for i in range(LEVELS):
        run = "PARTITION BY g, r // 16 ORDER BY r ROWS BETWEEN"
        out += [
            f"{name}c{i} AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}{i})",
            f"{name}{i + 1} AS (SELECT g, r // 16 AS r, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(d, '' ORDER BY r)) ELSE any_value(d) END AS d FROM {name}c{i} GROUP BY g, r // 16)",
            f"""{name}p{i} AS (SELECT g, r, CASE WHEN c > 1 THEN coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS lt,
              CASE WHEN c > 1 THEN coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS rt FROM {name}c{i})"""]
    return out


def climb(name: str, start: str, group: str, rank: str) -> tuple[list[str], str]:
    """``start`` (with proof and folded) taken up through the levels of a tree."""
    out, last = [], start
    for i in range(LEVELS):
        out.append(f"""{name}x{i} AS (SELECT x.* EXCLUDE (proof, folded), proof || coalesce(lt || rt, '') AS proof,
            CASE WHEN lt IS NULL THEN folded ELSE sha256(lt || folded || rt) END AS folded
          FROM {last} x JOIN {name}p{i} p ON p.g = {group} AND p.r = {rank} // {16 ** i})""")
        last = f"{name}x{i}"
    return out, last


def statement() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = crc32("doc_id::VARCHAR")
    within, last = climb("n", "st", "x.g", "x.r")
    upon, end = climb("t", "su", "0", "x.gr")
    parts = [
        f"""lv AS (SELECT doc_id, coalesce('=' || source, '-') AS g, {leaf('text')} AS d,
          {leaf(f"CASE WHEN {crc} % 5 = 0 THEN {lower} ELSE text END")} AS other FROM documents)""",
        "lr AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS r FROM lv)",
        *tree("n", "SELECT g, r, d FROM lr"),
        f"gr AS (SELECT g AS src, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS gr FROM n{LEVELS})",
        *tree("t", "SELECT 0 AS g, gr AS r, subroot AS d FROM gr"),
        "st AS (SELECT doc_id, g, r, d AS leaf, '' AS proof, other AS folded FROM lr)", *within,
        f"su AS (SELECT x.*, gr.subroot, gr.gr FROM {last} x JOIN gr ON gr.src = x.g)", *upon]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM {end}, (SELECT d AS root FROM t{LEVELS})"""


SQL = statement()
