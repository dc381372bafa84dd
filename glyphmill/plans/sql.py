"""Building blocks of the SQL that states the queries a second time."""

from __future__ import annotations

import base64

from glyphmill.functions.characters import WHITE_SPACE, byte_alphabet
from glyphmill.operators.tokenizer import Tokenizer
from glyphmill.plans import samples

#: White space for a character class (the other engine's ``\s`` is ASCII), with and without line ends.
SPACES = "".join(f"\\x{{{ord(c):X}}}" for c in sorted(WHITE_SPACE))
_NO_LINES = "".join(f"\\x{{{ord(c):X}}}" for c in sorted(WHITE_SPACE) if c not in "\r\n")
PUNCT = r"!-/:-@\[-`{-~\p{P}"
_CUT = "chr(57344)"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ahead(pattern: str) -> tuple[str, str]:
    """The pattern without its lookahead, and the white space that may stand last before a word."""
    return pattern.replace(r"|\s+(?!\S)", "").replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]"), (_NO_LINES if r"[\r\n]" in pattern else SPACES)


def chunks(pattern: str, text: str = "text") -> str:
    """A list of stretches of the text: white space before a word's own last one ends a stretch.

    That is what ``\\s+(?!\\S)`` does, in an engine without lookahead: the last white space before a word goes to the word.
    """
    _, last = _ahead(pattern)
    marked = f"regexp_replace({text}, '([{SPACES}])([{last}][^{SPACES}])', '\\1' || {_CUT} || '\\2', 'g')"
    return f"string_split({marked}, {_CUT})"


def pieces(pattern: str, source: str) -> str:
    """Rows (doc_id, piece) of a covering pattern over a table or subquery with doc_id and text."""
    plain, _ = _ahead(pattern)
    return f"SELECT doc_id, unnest(regexp_extract_all(chunk, {_text(plain)}, 0)) AS piece FROM (SELECT doc_id, unnest({chunks(pattern)}) AS chunk FROM {source})"


def placed_pieces(pattern: str) -> str:
    """The same with the places c (of the stretch) and p (in it)."""
    plain, _ = _ahead(pattern)
    inner = f"SELECT doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS c FROM (SELECT doc_id, {chunks(pattern)} AS cs FROM documents)"
    return f"SELECT doc_id, c, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM (SELECT doc_id, c, regexp_extract_all(chunk, {_text(plain)}, 0) AS ps FROM ({inner}))"


LINE_PARTS = "(SELECT doc_id, unnest(regexp_extract_all(text, '\\n+[^\\n]*|[^\\n]+', 0)) AS text FROM documents)"
DIGITS_BY_THREE = "(SELECT doc_id, unnest(regexp_extract_all(text, '\\p{N}{1,3}|\\P{N}+', 0)) AS text FROM documents)"
DIGIT_PARTS = "(SELECT doc_id, unnest(regexp_extract_all(text, '\\p{N}|\\P{N}+', 0)) AS text FROM documents)"


def kimi_pieces() -> str:
    """Runs of Han apart; in the rest no letter is Han, so the pattern needs no intersection of classes."""
    from glyphmill.functions.pretok import KIMI

    han = "(SELECT doc_id, unnest(regexp_extract_all(text, '\\p{Han}+|\\P{Han}+', 0)) AS text FROM documents)"
    return pieces(KIMI.replace(r"&&[^\p{Han}]", ""), han)


def deepseek_pieces() -> str:
    """Digits in threes, runs of CJK and kana, and what the last pattern makes of the rest; other characters by themselves."""
    from glyphmill.functions.pretok import DEEPSEEK3

    runs = f"SELECT doc_id, unnest(regexp_extract_all(text, '\\p{{N}}{{1,3}}|[一-龥぀-ゟ゠-ヿ]+|[^\\p{{N}}一-龥぀-ゟ゠-ヿ]+', 0)) AS text FROM documents"
    whole = "regexp_full_match(text, '\\p{N}+|[一-龥぀-ゟ゠-ヿ]+')"
    return f"SELECT doc_id, text AS piece FROM ({runs}) WHERE {whole} UNION ALL ({pieces(DEEPSEEK3[2], f'(SELECT * FROM ({runs}) WHERE NOT {whole})')})"


# Symbols of a text stand between two private characters each; a merge is then a replacement, leftmost first, and merges
# in rank order give what the model gives, since a merge makes only symbols that no earlier merge uses.
_OPEN, _SHUT = chr(57345), chr(57346)


def _merged(text: str, merges: list[tuple[str, str]]) -> str:
    out = text
    for a, b in merges:
        out = f"replace({out}, {_text(_OPEN + a + _SHUT + _OPEN + b + _SHUT)}, {_text(_OPEN + a + b + _SHUT)})"
    return out


def _symbols(text: str) -> str:
    return f"regexp_replace({text}, '(?s)(.)', '{_OPEN}\\1{_SHUT}', 'g')"


def _plain_merges() -> list[tuple[str, str]]:
    back = {c: chr(b) for b, c in byte_alphabet().items()}
    return [("".join(back[c] for c in a), "".join(back[c] for c in b)) for a, b in samples.byte_merges()]


def bpe_texts() -> str:
    return f"SELECT doc_id, lang, source, text AS raw, {_merged_column('text')} AS merged_text, text FROM documents"


def bpe_turns() -> str:
    return f"SELECT role, {_merged_column('role')} AS merged_role_spaced, role AS role_spaced, {_merged_column('text')} AS merged_text, text FROM conversations"


def _merged_column(text: str) -> str:
    from glyphmill.functions.pretok import GPT2

    plain, _ = _ahead(GPT2)
    mark = chr(57347)
    cut = f"array_to_string([array_to_string(regexp_extract_all(x, {_text(plain)}, 0), '{mark}') for x in {chunks(GPT2, text)}], '{mark}')"
    return _merged(_symbols(cut), _plain_merges())


def bpe_count(text: str) -> str:
    """Symbols after the merges, less the marks between pieces; a character of more bytes has no merges and as many symbols."""
    merged = f"merged_{text}"
    symbols = f"length({merged}) - length(replace({merged}, '{_OPEN}', ''))"
    marks = f"length({merged}) - length(replace({merged}, '{chr(57347)}', ''))"
    return f"(({symbols}) - ({marks}) + (strlen({text}) - length({text})))"


def _byte_ids() -> str:
    """(id, token) of the vocabulary as plain ASCII text, and (id, hex) of single bytes."""
    vocab = samples.byte_vocab()
    back = {c: chr(b) for b, c in byte_alphabet().items()}
    return ", ".join(f"({i}, {_text(''.join(back[c] for c in s))})" for s, i in vocab.items() if s not in samples.SPECIALS and all(ord(back[c]) < 128 and back[c] != chr(0) for c in s))


def bpe_top() -> str:
    """Ids of symbols; a character of more bytes has no merges, and an id for each byte."""
    single = ", ".join(f"({samples.byte_vocab()[c]}, '{b:02X}')" for b, c in byte_alphabet().items() if b > 127)
    return (
        f"WITH symbols AS (SELECT unnest(regexp_extract_all(merged_text, '{_OPEN}([^{_SHUT}]*){_SHUT}', 1)) AS token FROM ({bpe_texts()})), "
        "bytes AS (SELECT unnest(regexp_extract_all(hex(encode(token)), '..', 0)) AS code FROM symbols WHERE regexp_full_match(token, '[^\\x00-\\x7F]') AND token <> chr(57347)) "
        f"SELECT id::BIGINT AS id, count(*) AS n FROM (SELECT id FROM symbols JOIN (VALUES {_byte_ids()}) v(id, token) USING (token) UNION ALL SELECT id FROM bytes JOIN (VALUES {single}) w(id, code) USING (code)) GROUP BY id"
    )


def token_bytes() -> str:
    """(id, bytes in base64) of the byte-level vocabulary."""
    back = {c: bytes([b]) for b, c in byte_alphabet().items()}
    return _values([(i, base64.b64encode(b"".join(back[c] for c in s)).decode()) for s, i in samples.byte_vocab().items() if s not in samples.SPECIALS])


def source_ids() -> str:
    """(doc_id, ids) of the ASCII column ``source``: its symbols after the merges, looked up one by one."""
    table = "MAP {" + ", ".join(f"{_text(''.join(chr(b) for x in s for b, c in byte_alphabet().items() if c == x))}: {i}" for s, i in samples.byte_vocab().items() if s.isascii() and s.isalnum()) + "}"
    return f"SELECT doc_id, [{table}[t] FOR t IN regexp_extract_all({_merged_column('source')}, '{_OPEN}([a-z0-9]*){_SHUT}', 1)] AS ids FROM documents"


def bpe_modes() -> str:
    marked, plain = "'<s>' || role || '</s>' || text || '<pad>'", "'<s>' || role || '</s>' || text"
    columns = ", ".join(f"({e}) AS {n}, {_merged_column(f'({e})')} AS merged_{n}" for n, e in (("marked", marked), ("plain", plain), ("role_only", "role"), ("own", "text")))
    return f"SELECT conv_id, turn, {columns} FROM conversations"


def isolation() -> str:
    """Whether an added token's string can come from the model: a byte by itself, or a merge of two."""
    added = ", ".join(f"({_text(s)})" for s in samples.SPECIALS)
    return f"NOT EXISTS (SELECT 1 FROM (VALUES {added}) a(token) WHERE length(token) = 1 OR token IN (SELECT \"left\" || \"right\" FROM (VALUES {merge_values()}) m(rank, \"left\", \"right\")))"


def spm_count() -> str:
    pairs = samples.SPM_MERGES
    known = {"▁", *"abcdefghijklmnopqrstuvwxyz.,", *(a + b for a, b in pairs)}
    merges = [p for p in pairs if p[0] in known and p[1] in known]
    marked = "CASE WHEN text = '' OR starts_with(replace(text, ' ', '▁'), '▁') THEN replace(text, ' ', '▁') ELSE '▁' || replace(text, ' ', '▁') END"
    # a mark starts a piece: no merge reaches over it, since none has the mark second
    merged = _merged(_symbols(marked), merges)
    symbols = f"(length({merged}) - length(replace({merged}, '{_OPEN}', '')))"
    other = f"regexp_replace({marked}, '[a-z.,▁]', '', 'g')"
    return f"({symbols} + strlen({other}) - length({other}))"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def vocab_values() -> str:
    t: Tokenizer = samples.byte_level()
    return ", ".join(f"({i}::BIGINT, {_text(s)}, {t.id_flags(i)}::BIGINT)" for i, s in sorted(t._strings.items()))


def merge_values() -> str:
    return ", ".join(f"({k}::BIGINT, {_text(a)}, {_text(b)})" for k, (a, b) in enumerate(samples.byte_merges()))


def words_values() -> str:
    return _values([(w,) for w in dict.fromkeys(samples.WORDS.split())])


#: White space to spaces, control and format characters out, lower case.
BERT = f"lower(regexp_replace(regexp_replace(text, '[{SPACES}]', ' ', 'g'), '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]', '', 'g'))"


def wordpiece(select: str) -> str:
    """``words`` (doc_id, word) and ``parts`` (word, k, id): greedy longest match by recursion over the distinct words."""
    values = _values([(i, w) for i, w in enumerate(samples.word_vocab())])
    longest = max(map(len, samples.word_vocab()))
    normal = BERT
    return f"""WITH RECURSIVE vocab(id, token) AS (VALUES {values}),
words AS (SELECT doc_id, unnest(regexp_extract_all({normal}, '[{PUNCT}]|[^{SPACES}{PUNCT}]+', 0)) AS word FROM documents),
uniq AS (SELECT DISTINCT word FROM words),
walk(word, k, pos, id) AS (
  SELECT word, 0, 1, NULL::INTEGER FROM uniq WHERE length(word) <= 12
  UNION ALL
  SELECT word, k + 1, pos + len, id FROM (
    SELECT w.word, w.k, w.pos, l.len, v.id, row_number() OVER (PARTITION BY w.word, w.k ORDER BY l.len DESC) AS r
    FROM walk w JOIN (SELECT unnest(range(1, {longest + 1})) AS len) l ON w.pos + l.len - 1 <= length(w.word)
    JOIN vocab v ON v.token = CASE WHEN w.pos = 1 THEN '' ELSE '##' END || substr(w.word, w.pos, l.len)) WHERE r = 1),
whole AS (SELECT word FROM walk WHERE pos = length(word) + 1),
parts AS (SELECT word, k, id::VARCHAR AS id FROM walk WHERE k > 0 AND word IN (SELECT word FROM whole)
  UNION ALL SELECT word, 1, '1' FROM uniq WHERE word NOT IN (SELECT word FROM whole))
{select}"""


def unigram_counts() -> str:
    """Tokens of each document: the best path of every distinct piece by a recursion over its places, which keeps for each
    place the best sum, the tokens on the way and whether the last was unknown (unknown neighbours are one token)."""
    t: Tokenizer = samples.unigram()
    values = ", ".join(f"({_text(p)}, {s!r}::DOUBLE)" for p, s in t.definition.scores if p != "<unk>")
    longest = max(len(p) for p, _ in t.definition.scores)
    unknown = min(s for _, s in t.definition.scores) - 10.0
    marked = "replace(lower(text), ' ', '▁')"
    marked = f"CASE WHEN text = '' OR starts_with({marked}, '▁') THEN {marked} ELSE '▁' || {marked} END"
    return f"""WITH RECURSIVE vocab(token, score) AS (VALUES {values}),
own AS (SELECT doc_id, unnest(regexp_extract_all({marked}, '▁[^▁]*|[^▁]+', 0)) AS piece FROM documents),
uniq AS (SELECT DISTINCT piece FROM own),
walk(piece, pos, sums, counts, unknown) AS (
  SELECT piece, 0, [0.0::DOUBLE], [0], [false] FROM uniq
  UNION ALL
  SELECT piece, pos + 1, list_append(sums, s), list_append(counts, counts[start + 1] + CASE WHEN u AND unknown[start + 1] THEN 0 ELSE 1 END), list_append(unknown, u) FROM (
    SELECT *, row_number() OVER (PARTITION BY piece ORDER BY s DESC, start) AS r FROM (
      SELECT w.piece, w.pos, w.sums, w.counts, w.unknown, w.pos + 1 - l.len AS start, v.token IS NULL AS u, coalesce(v.score, {unknown!r}::DOUBLE) + w.sums[w.pos + 2 - l.len] AS s
      FROM walk w JOIN (SELECT unnest(range(1, {longest + 1})) AS len) l ON l.len <= w.pos + 1 LEFT JOIN vocab v ON v.token = substr(w.piece, w.pos + 2 - l.len, l.len)
      WHERE w.pos < length(w.piece) AND (v.token IS NOT NULL OR l.len = 1))) WHERE r = 1),
ends AS (SELECT piece, counts[pos + 1] AS n FROM walk WHERE pos = length(piece))
SELECT d.doc_id, coalesce(sum(e.n), 0)::BIGINT AS n_tokens FROM documents d LEFT JOIN own USING (doc_id) LEFT JOIN ends e USING (piece) GROUP BY d.doc_id"""


# ---- cuts, stated over single characters: the classes of three neighbours


def _kind(family: str) -> str:
    """The class of a character ``ch``, written out by hand."""
    if family == "deepseek3":
        own, rest = [("C", "[一-龥぀-ゟ゠-ヿ]"), ("L", r"[\p{L}\p{M}]"), ("N", r"\p{N}"), ("P", r"[\p{P}\p{S}]")], "X"
        plain = ""
    else:
        own, rest = [("L", r"\p{L}"), ("M", r"\p{M}"), ("N", r"\p{N}")], "P"
        plain = "WHEN ch = chr(39) THEN 'A' " + ("WHEN ch = '/' THEN 'D' " if family == "o200k" else "")
    sets = " ".join(f"WHEN regexp_full_match(ch, '{p}') THEN '{c}'" for c, p in own)
    return f"CASE WHEN ch = ' ' THEN 'S' WHEN ch IN (chr(10), chr(13)) THEN 'E' {plain}WHEN regexp_full_match(ch, '[{SPACES}]') THEN 'W' {sets} ELSE '{rest}' END"


#: The neighbours (a, b) with a sure cut between: after a class, the classes that may follow.  White space by itself alone.
SURE = {
    "cl100k": {"L": "MNSWEAP", "M": "NSW", "N": "LMSWEAP", "A": "NSW", "P": "NSW", "E": "LMNAP", "S": "N", "W": "MNAP"},
    "o200k": {"L": "NSWEPD", "M": "NSW", "N": "LMSWEAPD", "A": "NSW", "P": "NSW", "D": "NSW", "E": "LMNAP", "S": "N", "W": "N"},
    "deepseek3": {"C": "LNPSWEX", "L": "CNPSWEX", "N": "CLPSWEX", "P": "CNSWX", "X": "CNPSWE", "E": "CLNPX", "S": "CNX", "W": "CNPX"},
}


def sure_places(family: str) -> str:
    """How many places each document has."""
    pairs = ", ".join(f"'{a}{b}'" for a, after in SURE[family].items() for b in after)
    return (
        f"SELECT doc_id, count(*) FILTER (a || b IN ({pairs}) AND NOT (a IN ('S', 'W') AND z IN ('S', 'W', 'E'))) AS n_places FROM ("
        "SELECT doc_id, k AS a, lead(k) OVER w AS b, coalesce(lag(k) OVER w, '') AS z FROM ("
        f"SELECT doc_id, i, {_kind(family)} AS k FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> '')"
        ") WINDOW w AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id"
    )


def piece_digest(ordered: str) -> str:
    """Pieces of each document, and a digest of them in order, from rows (doc_id, piece, o)."""
    return f"SELECT doc_id, count(*) AS n_pieces, md5(string_agg(piece, chr(57347) ORDER BY o)) AS h FROM ({ordered}) GROUP BY doc_id"


def covering_order(pattern: str) -> str:
    return f"SELECT doc_id, piece, (c::BIGINT << 32) + p AS o FROM ({placed_pieces(pattern)})"


def deepseek_order() -> str:
    """The pieces of ``deepseek_pieces`` in order: runs, then the last pattern's stretches and pieces in each."""
    from glyphmill.functions.pretok import DEEPSEEK3

    plain, _ = _ahead(DEEPSEEK3[2])
    split = r"regexp_extract_all(text, '\p{N}{1,3}|[一-龥぀-ゟ゠-ヿ]+|[^\p{N}一-龥぀-ゟ゠-ヿ]+', 0)"
    runs = f"SELECT doc_id, unnest({split}) AS text, generate_subscripts({split}, 1) AS r FROM documents"
    whole = r"regexp_full_match(text, '\p{N}+|[一-龥぀-ゟ゠-ヿ]+')"
    stretches = f"SELECT doc_id, r, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS c FROM (SELECT doc_id, r, {chunks(DEEPSEEK3[2])} AS cs FROM ({runs}) WHERE NOT {whole})"
    inner = f"SELECT doc_id, r, c, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM (SELECT doc_id, r, c, regexp_extract_all(chunk, {_text(plain)}, 0) AS ps FROM ({stretches}))"
    return f"SELECT doc_id, text AS piece, (r, 0, 0) AS o FROM ({runs}) WHERE {whole} UNION ALL SELECT doc_id, piece, (r, c, p) AS o FROM ({inner})"


# ---- a published vocabulary, read from its file: merges by recursion over the distinct pieces of all texts


def byte_pairs(path: str, pattern: str, select: str) -> str:
    """``own`` (doc_id, piece, o), ``made`` (piece, symbols) and ``vocab`` (token, id), then the query ``select``."""
    table = "MAP {" + ", ".join(f"'{b:02X}': {_text(c)}" for b, c in byte_alphabet().items()) + "}"
    file = f"(SELECT content FROM read_text({_text(path)}))"
    return f"""WITH RECURSIVE pairs AS (SELECT unnest(x) AS p, generate_subscripts(x, 1) AS rank FROM (SELECT CAST(json_extract(content, '$.model.merges') AS VARCHAR[][]) AS x FROM {file})),
merges AS (SELECT p[1] AS l, p[2] AS r, max(rank) AS rank FROM pairs GROUP BY 1, 2),
entries AS (SELECT unnest(map_entries(CAST(json_extract(content, '$.model.vocab') AS MAP(VARCHAR, BIGINT)))) AS e FROM {file}),
vocab AS (SELECT e.key AS token, e.value AS id FROM entries),
own AS ({covering_order(pattern)}),
uniq AS (SELECT DISTINCT piece FROM own),
walk(piece, symbols) AS (
  SELECT piece, list_transform(regexp_extract_all(hex(encode(piece)), '..', 0), lambda h: {table}[h]) FROM uniq
  UNION ALL
  SELECT piece, symbols[1:i - 1] || [symbols[i] || symbols[i + 1]] || symbols[i + 2:] FROM (
    SELECT w.piece, w.symbols, w.i, row_number() OVER (PARTITION BY w.piece ORDER BY m.rank, w.i) AS n
    FROM (SELECT piece, symbols, unnest(range(1, len(symbols))) AS i FROM walk) w JOIN merges m ON m.l = w.symbols[w.i] AND m.r = w.symbols[w.i + 1]) WHERE n = 1),
made AS (SELECT piece, arg_min(symbols, len(symbols)) AS symbols FROM walk GROUP BY piece)
{select}"""


def whole_text_count() -> str:
    """Tokens of texts that are one piece each: marks for spaces and one before, merges over the whole, bytes for what the
    vocabulary lacks."""
    pairs = samples.SPM_MERGES
    known = {"▁", *"abcdefghijklmnopqrstuvwxyz.,", *(a + b for a, b in pairs)}
    marked = "CASE WHEN text = '' THEN '' ELSE '▁' || replace(text, ' ', '▁') END"
    merged = _merged(_symbols(marked), [p for p in pairs if p[0] in known and p[1] in known])
    other = f"regexp_replace({marked}, '[a-z.,▁]', '', 'g')"
    return f"((length({merged}) - length(replace({merged}, '{_OPEN}', ''))) + strlen({other}) - length({other}))"
