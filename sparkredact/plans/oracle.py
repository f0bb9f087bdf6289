"""The detectors said in DuckDB's SQL, whose patterns have no look-around: guards consume a character instead,
which tells as well whether a match exists."""

from __future__ import annotations

from ..functions.lexicon import (
    BAHT,
    CATEGORIES,
    CURRENCY_CODES,
    CURRENCY_SYMBOLS,
    GIVEN_NAMES,
    LATIN_JOB_PHRASES,
    LATIN_JOB_WORDS,
    LATIN_MONTHS,
    LATIN_ORG_WORDS,
    NAME_LABELS,
    PERSON_TITLES,
    THAI_ADDRESS_WORDS,
    THAI_HONORIFICS,
    THAI_HONORIFICS_DEGRADED,
    THAI_JOB_TITLES,
    THAI_MONTHS,
    THAI_NAME_LABELS,
    THAI_ORG_WORDS,
    TOP_LEVEL_DOMAINS,
)
from ..operators.layers import CREDENTIALS

_S_IN = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_S, _NS, _D, _W_IN = f"[{_S_IN}]", f"[^{_S_IN}]", r"\p{Nd}", r"\p{L}\p{N}_"
_THAI, _CONSONANT = r"\x{0E00}-\x{0E7F}", r"\x{0E01}-\x{0E2E}"
_AHEAD, _AFTER = f"(?:^|[^{_W_IN}])", f"(?:[^{_W_IN}]|$)"
_DASH = f"[{_S_IN}\\-]"
_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_GAP = f"[{_S_IN}\\-.]?"
_PHONE = f"(?:\\+{_D}{{1,3}}{_GAP}(?:\\(?{_D}{{1,4}}\\)?{_GAP})?{_D}{{2,4}}(?:{_GAP}{_D}{{2,4}}){{1,3}}|0{_D}{{1,2}}{_GAP}{_D}{{3}}{_GAP}{_D}{{3,4}})"
_H = "[0-9A-Fa-f]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(words) -> str:
    return "(?:" + "|".join("".join("\\" + c if c in ".-" else c for c in w) for w in words) + ")"


def _has(pattern: str, text: str = "t") -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


def _any(*tests: str) -> str:
    return "(" + " OR ".join(tests) + ")"


def _token(words, joined: str) -> str:
    return _has(f" (?i:{_words(words)})\\.* ", joined)


def _ascii_digits(text: str) -> str:
    return f"translate(regexp_replace({text}, '[^\\p{{Nd}}]', '', 'g'), '๐๑๒๓๔๕๖๗๘๙', '0123456789')"


def _extracted(pattern: str) -> str:
    return f"regexp_extract_all(t, {quoted(pattern)}, 1)"


def _thai_id() -> str:
    core = f"{_D}{_DASH}?{_D}{{4}}{_DASH}?{_D}{{5}}{_DASH}?{_D}{{2}}{_DASH}?{_D}"
    found = f"list_transform({_extracted(f'(?:^|[^{_D}])({core})(?:[^{_D}]|$)')}, lambda m: {_ascii_digits('m')})"
    total = "list_sum(list_transform(range(1, 13), lambda i: substr(d, i::INT, 1)::INT * (14 - i)))"
    return f"len(list_filter({found}, lambda d: (11 - {total} % 11) % 10 = substr(d, 13, 1)::INT)) > 0"


def _card() -> str:
    found = f"list_transform({_extracted('(?:^|[^0-9])((?:[0-9][ -]?){12,18}[0-9])(?:[^0-9]|$)')}, lambda m: reverse(regexp_replace(m, '[ -]', '', 'g')))"
    value = "substr(d, i::INT, 1)::INT"
    luhn = f"list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {value} ELSE ({value} * 2) // 10 + ({value} * 2) % 10 END))"
    return f"len(list_filter({found}, lambda d: {luhn} % 10 = 0)) > 0"


def _iban() -> str:
    found = f"list_transform({_extracted('(?:^|[^A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?:[^A-Za-z0-9]|$)')}, lambda m: replace(m, ' ', ''))"
    codes = "list_transform(string_split(substr(d, 5) || substr(d, 1, 4), ''), lambda c: CASE WHEN ascii(c) < 65 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    rest = f"list_reduce(list_prepend(0, {codes}), lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97)"
    return f"len(list_filter({found}, lambda d: len(d) BETWEEN 15 AND 34 AND {rest} = 1)) > 0"


def _thai_person() -> str:
    tests = [_has(f"(?:{_words(THAI_NAME_LABELS)[3:-1]})(?s:.*)[{_THAI}]")]
    for h in dict.fromkeys(THAI_HONORIFICS_DEGRADED + THAI_HONORIFICS):
        tests.append(f"(strpos(t, {quoted(h)}) > 0 AND {_has(f'^{_S}*(?:[{_THAI}]|\\p{{L}})', f'substr(t, strpos(t, {quoted(h)}) + {len(h)})')})")
    return f"({_has(f'[{_THAI}]')} AND {_any(*tests)})"


def _latin_person() -> str:
    rest = "lower(b)"
    for label in NAME_LABELS:
        rest = f"replace({rest}, {quoted(label)}, ' ')"
    word = r"[A-Z](?:[\-']*[a-z])+[\-']*\.* "
    run = f"({_has(f' {word}{word}', 'bj')} AND NOT {_token(LATIN_ORG_WORDS, 'bj')})"
    return _any(f"({_has(_words(NAME_LABELS), 'lower(b)')} AND {_has('[a-z]', rest)})", _has(f" (?i:{_words(PERSON_TITLES)})\\.* [A-Z]", "bj"), _token(GIVEN_NAMES, "bj"), run)


_CODE = f"(?:{'|'.join(CURRENCY_CODES)})"
_SYMBOL = f"[{CURRENCY_SYMBOLS}]"
_URL = f"(?i)(^|[^{_W_IN}])(?:(?:https?://|ftp://|www\\.){_NS}+|(?:[a-z0-9](?:[a-z0-9\\-]*[a-z0-9])?\\.)+(?:{'|'.join(TOP_LEVEL_DOMAINS)})(?:/{_NS}*)?)"

FLAGS = {
    "thai_national_id": _thai_id(),
    "bank_account": _has(f"(?:^|[^{_D}]){_D}{{3}}{_DASH}{_D}{_DASH}{_D}{{5,6}}{_DASH}{_D}(?:[^{_D}]|$)"),
    "passport_number": _has(f"(?:^|[^A-Za-z0-9])[A-Z]{{1,2}}{_D}{{6,7}}(?:[^A-Za-z0-9]|$)"),
    "license_plate": _has(f"(?:^|[^{_THAI}{_W_IN}]){_D}?[{_CONSONANT}]{{1,2}}{_S}?{_D}{{1,4}}(?:[^{_THAI}{_W_IN}]|$)"),
    "date_of_birth": _any(
        _has(f"(?:^|[^{_D}])[0-3]?{_D}[/\\-.][01]?{_D}[/\\-.](?:{_D}{{4}}|{_D}{{2}})(?:[^{_D}]|$)"),
        _has(f"(?i)(?:^|[^{_D}])[0-3]?{_D}{_S}+(?:{'|'.join(LATIN_MONTHS)})\\.?{_S}+{_D}{{4}}(?:[^{_D}]|$)"),
        f"({_has(_words(THAI_MONTHS))} AND {_has(_D + '{4}')})",
    ),
    "thai_address": _any(_has(_words(THAI_ADDRESS_WORDS)), _has(f"(?:^|[^{_THAI}])(?:[อจ]\\.{_S}?[{_CONSONANT}]|ต\\.(?: ?[\\x{{0E01}}-\\x{{0E03}}\\x{{0E05}}-\\x{{0E2E}}]|[{_S_IN.replace('x1c-\\x20', 'x1c-\\x1f')}][{_CONSONANT}]))")),
    "job_title": _any(_has(_words(THAI_JOB_TITLES)), _has(_words(LATIN_JOB_PHRASES), "lower(t)"), _token(LATIN_JOB_WORDS, "tj")),
    "email": _has(_EMAIL),
    "url": _has(_URL),
    "money_amount": _has(f"(?i)(?:{_SYMBOL}{_S}?{_D}|{_D}{_S}?(?:{_SYMBOL}|{BAHT})|{_AHEAD}{_CODE}{_S}?{_D}+{_AFTER}|{_AHEAD}{_D}+{_S}?{_CODE}{_AFTER})"),
    "percent_value": _has(f"(?:^|[^{_W_IN}.]){_D}+(?:[.,]{_D}+)?{_S}?%"),
    "access_token": _any(
        _has(f"{_AHEAD}eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+"),
        _has(f"{_AHEAD}gh[pousr]_[A-Za-z0-9]{{20,}}"),
        _has(f"(?i){_AHEAD}bearer{_S}+[A-Za-z0-9._\\-]{{8,}}"),
        _has(f"(?i){_AHEAD}(?:access[_\\-]?token|auth[_\\-]?token|token){_S}*[:=]{_S}*{_NS}{{6,}}"),
    ),
    "secret": _any(
        _has("-----BEGIN (?:RSA |EC |OPENSSH |PGP |DSA )?PRIVATE KEY-----"),
        _has(f"(?i){_AHEAD}[A-Z0-9_]*(?:secret|password|passwd|pwd|passphrase|token){_S}*[:=]{_S}*{_NS}{{4,}}"),
        _has(f"(?i){_AHEAD}[a-z][a-z0-9+.\\-]*://[^{_S_IN}:/@]+:[^{_S_IN}:/@]+@"),
    ),
    "key": _any(
        _has(f"{_AHEAD}sk-(?:proj-)?[A-Za-z0-9]{{16,}}"),
        _has(f"{_AHEAD}(?:AKIA|ASIA)[0-9A-Z]{{16}}{_AFTER}"),
        _has(f"{_AHEAD}AIza[0-9A-Za-z_\\-]{{35}}{_AFTER}"),
        _has(f"(?i){_AHEAD}(?:api[_\\-]?key|apikey|client[_\\-]?secret|secret[_\\-]?key){_S}*[:=]{_S}*{_NS}{{6,}}"),
        _has(f"(?i){_AHEAD}[A-Z0-9_]*KEY{_S}*[:=]{_S}*{_NS}{{3,}}"),
    ),
    "phone": f"len(list_filter({_extracted(f'(?:^|[^{_W_IN}])({_PHONE})(?:[^{_W_IN}]|$)')}, lambda m: len(regexp_replace(m, '[^\\p{{Nd}}]', '', 'g')) BETWEEN 7 AND 15)) > 0",
    "long_token": f"len(list_filter({_extracted(f'(?:^|[^{_W_IN}\\-])([A-Za-z0-9_\\-]{{24,}})(?:[^{_W_IN}\\-]|$)')}, lambda x: len(trim(x, '-')) >= 24 AND regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]'))) > 0",
    "organization_name": _any(_has(_words(THAI_ORG_WORDS)), _token(LATIN_ORG_WORDS, "bj")),
    "person_name": _any(_thai_person(), _latin_person()),
    "credit_card": _card(),
    "ip_address": _any(
        _has(f"(?:^|[^0-9A-Za-z.]|[^0-9]\\.){_OCTET}(?:\\.{_OCTET}){{3}}(?:\\.?$|[^0-9A-Za-z.]|\\.[^0-9])"),
        _has(f"(?:^|[^0-9A-Za-z:])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:|(?:{_H}:){{1,6}}:{_H}|(?:{_H}:){{1,5}}(?::{_H}){{2}}|(?:{_H}:){{1,4}}(?::{_H}){{3}}|(?:{_H}:){{1,3}}(?::{_H}){{4}}|(?:{_H}:){{1,2}}(?::{_H}){{5}}|{_H}:(?::{_H}){{6}}|:(?::{_H}){{1,7}})(?:[^0-9A-Za-z:]|$)"),
    ),
    "iban": _iban(),
    # The check digits of base 58 and bech32 have no short SQL; the shapes do.
    "crypto_wallet": _has("(?:^|[^A-Za-z0-9])(?:0x[0-9A-Fa-f]{40}|[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71})(?:[^A-Za-z0-9]|$)"),
}


def flagged(source: str) -> str:
    """A query over source (a table or query with the text t) that adds one boolean for each category."""
    parts = f"SELECT *, regexp_replace(regexp_replace(t, {quoted(_EMAIL)}, ' ', 'g'), {quoted(_URL)}, '\\1 ', 'g') AS b FROM ({source})"
    joined = "' ' || array_to_string(regexp_extract_all({0}, '[A-Za-z][A-Za-z.\\-'']*'), ' ') || ' '"
    parts = f"SELECT *, {joined.format('t')} AS tj, {joined.format('b')} AS bj FROM ({parts})"
    raw = ", ".join(f"{sql} AS f_{name}" for name, sql in FLAGS.items())
    parts = f"SELECT *, {raw} FROM ({parts})"
    none = " AND ".join(f"NOT f_{c}" for c in ("key", "access_token", "email", "url", "thai_national_id", "bank_account", "passport_number"))
    own = {c: f"f_{c}" for c in CATEGORIES} | {"phone_number": "(f_phone AND NOT f_thai_national_id)", "api_key": f"(f_key OR (f_long_token AND {none}))"}
    return f"SELECT *, {', '.join(f'{sql} AS {c}' for c, sql in own.items())} FROM ({parts})"


def categories(source: str) -> str:
    """A query over source that adds categories, the sorted list of those that hold."""
    each = ", ".join(f"CASE WHEN {c} THEN '{c}' END" for c in CATEGORIES)
    return f"SELECT *, list_sort(list_filter([{each}], lambda c: c IS NOT NULL)) AS categories FROM ({flagged(source)})"


def lines_of(table: str, key: str, *keep: str) -> str:
    """The lines of a table's text that aren't blank, numbered from 0, as t."""
    kept = "".join(f", {c}" for c in keep)
    split = f"SELECT {key}{kept}, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10)))))::INT AS seg_idx FROM {table} WHERE text IS NOT NULL"
    return f"SELECT {key}::VARCHAR AS image_id, seg_idx, t{kept} FROM ({split}) WHERE NOT regexp_matches(t, '^{_S}*$')"


def credentials(text: str) -> str:
    """The list of what the credentials in a text count as; look-around is said by consuming a character."""
    ahead = {"(?<![A-Za-z0-9])": "(?:^|[^A-Za-z0-9])", "(?<![0-9])": "(?:^|[^0-9])"}
    after = {"(?![A-Za-z0-9_\\-])": "(?:[^A-Za-z0-9_\\-]|$)", "(?![A-Za-z0-9])": "(?:[^A-Za-z0-9]|$)", "(?![0-9])": "(?:[^0-9]|$)"}
    tests = []
    for category, _, pattern in CREDENTIALS:
        for old, new in (ahead | after).items():
            pattern = pattern.replace(old, new)
        tests.append(f"CASE WHEN {_has(pattern, text)} THEN '{category}' END")
    return f"list_filter([{', '.join(tests)}], lambda c: c IS NOT NULL)"
