"""Inputs of table size made from the tables at hand, in SQL that Spark and DuckDB both read.

Each line is right for some keys and nearly right for others: a wrong check digit, a missing mark, a run too short.
"""

from __future__ import annotations

_K = "c_custkey"
#: Hexadecimal digits that no wallet's address begins with.
_HEX = f"concat('f', substr(md5(CAST({_K} AS STRING)), 2))"


def _padded(value: str, n: int) -> str:
    return f"lpad(CAST({value} AS STRING), {n}, '0')"


def _one_of(by: str, *texts: str) -> str:
    return f"CASE {by} % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts[:-1])) + f" ELSE {texts[-1]} END"


#: What the line of a customer says, by kinds that take turns.
_SAID = [
    f"concat('ID 1-', {_padded(f'{_K} * 7 % 10000', 4)}, '-', {_padded(f'{_K} * 13 % 100000', 5)}, '-', {_padded(f'{_K} % 100', 2)}, '-', CAST(({_K} // 18) % 10 AS STRING))",
    f"concat('account ', {_padded(f'{_K} % 1000', 3)}, '-', CAST({_K} % 10 AS STRING), {_one_of(f'({_K} // 18)', repr('-'), repr(''))}, {_padded(f'{_K} * 31 % 100000', 5)}, '-', CAST({_K} % 7 AS STRING))",
    f"concat('passport ', chr(CAST(65 + ({_K} // 18) % 26 AS INT)), {_padded(f'{_K} * 37', 7)}, {_one_of(f'({_K} // 18)', repr(''), repr(' x'), repr('9'))})",
    f"concat('ทะเบียน ', substr('กขคงจฉชซ', CAST(({_K} // 18) % 7 + 1 AS INT), 2), {_one_of(f'({_K} // 18)', repr(' '), repr(''), repr('-'))}, CAST({_K} % 9000 + 1 AS STRING))",
    f"concat('born ', {_padded(f'({_K} // 18) % 45 + 1', 2)}, {_one_of(f'({_K} // 18)', repr('/'), repr('-'), repr(' '))}, {_padded(f'{_K} % 12 + 1', 2)}, '/', CAST(1950 + {_K} % 60 AS STRING))",
    f"concat({_one_of(f'({_K} // 18)', repr('อ.บางรัก '), repr('ต.ค. '), repr('ต. คลอง '), repr('ถนนสุขุมวิท '), repr('อ. '))}, CAST({_K} AS STRING))",
    f"concat({_one_of(f'({_K} // 18)', repr('the manager'), repr('a managerial'), repr('ผู้จัดการ'), repr('Vice President'), repr('nobody'))}, ' of ', {_HEX})",
    f"concat('use sk-', substr({_HEX}, 1, CAST(12 + ({_K} // 18) % 20 AS INT)), ' or ASIA', upper(substr({_HEX}, 1, CAST(14 + ({_K} // 18) % 4 AS INT))))",
    f"concat('pay to DE', {_one_of(f'({_K} // 18)', repr('89'), repr('88'), _padded(f'{_K} % 98', 2))}, '370400440532013000')",
    f"concat('send 0x', {_HEX}, substr({_HEX}, 1, CAST(7 + ({_K} // 18) % 3 AS INT)))",
    f"concat('key glpat-', substr({_HEX}, 1, CAST(18 + ({_K} // 18) % 5 AS INT)))",
    f"concat('bot ', {_padded(f'{_K} * 1009', 9)}, ':AA', {_HEX}, {_one_of(f'({_K} // 18)', repr('x'), repr('xy'))})",
    f"concat('npm_', {_HEX}, substr({_HEX}, 1, CAST(3 + ({_K} // 18) % 3 AS INT)))",
    f"concat('rk_live_', substr({_HEX}, 1, CAST(22 + ({_K} // 18) % 4 AS INT)))",
    f"concat({_HEX}, '-us', CAST(({_K} // 18) % 300 AS STRING))",
    f"concat('xoxb-', substr({_HEX}, 1, CAST(8 + ({_K} // 18) % 4 AS INT)))",
    f"concat('SK', {_HEX}, {_one_of(f'({_K} // 18)', repr(''), repr('0'))})",
    f"concat('-----BEGIN ', {_one_of(f'({_K} // 18)', repr('RSA '), repr(''), repr('OLD '))}, 'PRIVATE KEY-----')",
]

#: image_id, seg_idx and text of a line for each customer.
LINES = f"SELECT concat('c', CAST({_K} AS STRING)) AS image_id, 0 AS seg_idx, {_one_of(_K, *_SAID)} AS text FROM customer"

#: layer, image_id, seg_idx and categories (comma-joined; null: none): what two layers say of an order's lines.
OUTPUTS = " UNION ALL ".join(
    f"SELECT '{layer}' AS layer, CAST(o_custkey AS STRING) AS image_id, CAST(o_orderkey % 5 AS INT) AS seg_idx, CASE o_orderkey % {n} WHEN 0 THEN 'person_name,email' WHEN 1 THEN 'nonsense,url' WHEN 2 THEN 'iban' WHEN 3 THEN 'url,email' END AS categories FROM orders"
    for layer, n in (("a", 4), ("b", 7))
)

#: image_id, entity_group, score, start and end: an entity somewhere in a document.
ENTITIES = """SELECT CAST(doc_id AS STRING) AS image_id, CASE doc_id % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'Org' WHEN 2 THEN 'LAW' WHEN 3 THEN 'LOC' ELSE 'DATE' END AS entity_group,
CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id % 11 AS DOUBLE) / 10 END AS score, CAST(doc_id * 37 % 900 AS INT) AS "start", CAST(doc_id * 37 % 900 + doc_id % 120 AS INT) AS "end" FROM documents"""


def for_spark(sql: str) -> str:
    """The same for Spark, where // is written div and names are quoted otherwise."""
    return sql.replace(" // ", " div ").replace('"', "`")
