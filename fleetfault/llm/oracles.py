"""The same answers in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from fleetfault.llm import quality as q

# The template of a conversation, its digests, and the text under its loss mask.
FORMATTED = r"""WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (SELECT *, length(regexp_replace(text, '([<\[])(~*/?(?:s>|INST\]))', '\1~\2', 'g')) AS escaped FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(url_encode(role)) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""

# CRC-32 bit by bit: the remainder of each byte eight times by the fixed polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(lot, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda r, k: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"""


def _state(name: str, kept: str, other: str) -> str:
    """The best of deleting, keeping or giving another role, from one state; ``other``: the state a turn of the other side leads to."""
    ways = [f"{{'c': n.{name}.c + 2, 'a': 'D' || n.{name}.a, 'r': n.{name}.r}}"]
    said = "':' || d.text || chr(10)"
    new = "assistant" if other == "a" else "user"
    ways.append(
        f"CASE WHEN d.fault IN (0, 3) THEN {{'c': n.{other}.c + 1 + d.extra, 'a': 'R' || n.{other}.a, 'r': '{new}' || {said} || n.{other}.r}} END"
    )
    for initial, to in (pair.split(">") for pair in kept.split()):
        ways.append(
            f"CASE WHEN d.fault IN (0, 3) AND left(d.role, 1) = '{initial}' THEN {{'c': n.{to}.c + d.extra, 'a': 'K' || n.{to}.a, 'r': d.role || {said} || n.{to}.r}} END"
        )
    return f"least({', '.join(ways)}) AS {name}"


def _inserted(source: str, out: str) -> str:
    """One more inserted turn at this place, if it is better."""
    others = {"o": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user:", "a": "assistant:"}
    best = [
        f"least({q}, {{'c': {n}.c + 5, 'a': 'I' || {n}.a, 'r': '{names[n]}' || chr(10) || {n}.r}}) AS {q}" for q, n in others.items()
    ]
    return f"{out} AS (SELECT conv, nameless, pos, {', '.join(best)} FROM {source})"


# From the last row of a conversation back to its first: of each state (o: nothing yet, s, u, a) the cheapest way to the end.
REPAIRED = rf"""WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS lot FROM conversations),
fated AS (SELECT * REPLACE ({_CRC} % 20 AS lot) FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(CASE WHEN lot = 3 THEN 2 ELSE 1 END) WHERE lot <> 0),
placed AS (SELECT coalesce(conv_id, 0) AS conv, conv_id IS NULL AS nameless, turn, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv, nameless, role, text ORDER BY pos) AS nth FROM placed),
coded AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    CASE WHEN bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra,
    lag(role) OVER (PARTITION BY conv, nameless ORDER BY pos) AS before FROM counted),
back AS (
  SELECT conv, nameless, max(pos) + 1 AS pos, {{'c': 0, 'a': '', 'r': ''}} AS o, {{'c': 10, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS s,
    {{'c': 5, 'a': 'I', 'r': 'assistant:' || chr(10)}} AS u, {{'c': 0, 'a': '', 'r': ''}} AS a FROM coded GROUP BY 1, 2
  UNION ALL (
    WITH stepped AS (SELECT d.conv, d.nameless, d.pos, {_state("o", "s>s u>u", "u")}, {_state("s", "u>u", "u")}, {_state("u", "a>a", "a")}, {_state("a", "u>u", "u")}
      FROM back n JOIN coded d ON d.conv = n.conv AND d.nameless = n.nameless AND d.pos = n.pos - 1),
    {_inserted("stepped", "once")}, {_inserted("once", "twice")} SELECT * FROM twice)),
sums AS (SELECT conv, nameless, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY 1, 2)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.o.c, 0) AS BIGINT) AS cost,
  coalesce(b.o.a, '') AS audit, sha256(coalesce(left(b.o.r, length(b.o.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN sums s ON s.conv = coalesce(i.conv_id, 0) AND s.nameless = (i.conv_id IS NULL)
LEFT JOIN back b ON b.conv = s.conv AND b.nameless = s.nameless AND b.pos = 1"""

# All pairs that share a shingle, and what links reach.
JOINED = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS name FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT DISTINCT x AS doc_id, x AS other FROM ways UNION SELECT r.doc_id, w.y FROM reached r JOIN ways w ON w.x = r.other),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(l.component_id, w.doc_id) AS component_id,
  coalesce((SELECT min(o.doc_id) FROM sets o WHERE o.name = s.name), w.doc_id) AS class_id
FROM words w LEFT JOIN sets s ON s.doc_id = w.doc_id LEFT JOIN lowest l ON l.doc_id = w.doc_id"""



def _found(text: str, pattern: str) -> str:
    return "len(regexp_extract_all({}, '{}'))".format(text, pattern.replace("'", "''"))


# Windows of three words found again, lines found again, and the words in lines that fail.
JUDGED = rf"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, text, regexp_extract_all(text, '{q.WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{q.WORD}')) AS filled FROM texts),
windows AS (SELECT r, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS said FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM split)),
again AS (SELECT r, k FROM windows QUALIFY count(*) OVER (PARTITION BY r, said) > 1),
covered AS (SELECT r, count(DISTINCT k + d) AS n FROM again, range(3) t(d) GROUP BY r),
lines AS (SELECT r, line, {_found("line", q.WORD)} AS n, {_found("line", q.MENU_SEPARATOR)} - {_found("line", q.OPENING_MARK)} AS loose,
  {_found("line", q.BOILERPLATE)} AS phrases FROM (SELECT r, unnest(filled) AS line FROM split)),
lost AS (SELECT r, sum(n) AS n FROM lines WHERE (n < {q.MIN_OPEN_WORDS} AND NOT regexp_matches(line, '{q.SENTENCE_END.replace("'", "''")}'))
  OR (loose >= {q.MIN_SEPARATORS} AND n <= {q.MENU_WORDS} * loose) OR regexp_matches(line, '{q.MENU_LINE}') OR (phrases > 0 AND n <= {q.PHRASE_WORDS} * phrases) GROUP BY r),
counted AS (SELECT s.*, len(w) AS n_words, coalesce(c.n, 0) AS n_repeat_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_lost_words
  FROM split s LEFT JOIN covered c ON c.r = s.r LEFT JOIN lost l ON l.r = s.r),
based AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, length(array_to_string(w, '')) AS word_chars, {_found("text", q.SYMBOL)} AS n_symbols,
  CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_lost_words <= {q.MAX_LOST_PERCENT} * n_words AS kept, n_lost_words FROM based"""

ORACLES: dict[str, str] = {
    "op3_format_chats": FORMATTED,
    "op5_ngram_jaccard": JOINED,
    "op9_quality_rules": JUDGED,
    "op12_repair_conversations": REPAIRED,
}
