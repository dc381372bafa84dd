"""SQL for the small definitions of ``cases`` over the given tables: the models by recursion over distinct pieces."""

from __future__ import annotations

from glyphmill.functions.characters import byte_alphabet
from glyphmill.functions.pretok import GPT2
from glyphmill.operators.decoding import CLEAN_UP
from glyphmill.operators.tokenizer import Tokenizer
from glyphmill.plans import cases
from glyphmill.plans.sql import PUNCT, SPACES, _ahead, _text, _values, chunks, covering_order

_ALPHABET = "MAP {" + ", ".join(f"'{b:02X}': {_text(c)}" for b, c in byte_alphabet().items()) + "}"
_BYTE_SYMBOLS = f"list_transform(regexp_extract_all(hex(encode(piece)), '..', 0), lambda h: {_ALPHABET}[h])"
IDS = "SELECT doc_id, md5(string_agg(id::VARCHAR, ' ' ORDER BY o, k)) AS h, count(*) AS n_tokens FROM tokens JOIN vocab USING (token) GROUP BY doc_id"
#: The text in marked pieces: a mark for each space and one before, unless the text starts with one.
_MARKED = "CASE WHEN starts_with(text, ' ') THEN replace(text, ' ', '▁') ELSE '▁' || replace(text, ' ', '▁') END"
_ALWAYS = "'▁' || replace(text, ' ', '▁')"
#: The column with added tokens in it, by definition, and the stretches between them; a number stands for a token.
MARKED_TEXTS = {
    "added_options": ("lang || ' <one>, ' || source || '  <left> ' || lang || ' <right>  ' || source || '<one>'", ["lang || ' '", "<one>", "', ' || source", "<left>", "' ' || lang || ' '", "<right>", "source || '<one>'"]),
    "added_normalized": ("source || ' <raw> ' || lang || '<cafe' || chr(769) || '> ' || source", ["source || ' '", "<raw>", "' ' || lang", "<café>", "' ' || source"]),
}


def definition(name: str):
    return Tokenizer.from_str(cases.DEFINITIONS[name]).definition


def _vocab(name: str) -> str:
    d = definition(name)
    return f"vocab(token, id) AS (VALUES {_values(list((dict(d.vocab) | {t.content: t.id for t in d.added}).items()))})"


def merged(name: str, own: str, symbols: str, select: str) -> str:
    """``own`` gives rows (doc_id, o, piece); ``symbols`` is a piece's list before any merge."""
    d = definition(name)
    rows = [(a, b, k) for (a, b), k in {m: k for k, m in enumerate(d.merges)}.items()]
    if d.ignore_merges:
        joined = f"array_to_string({symbols}, '')"
        symbols = f"CASE WHEN {joined} IN (SELECT token FROM vocab) THEN [{joined}] ELSE {symbols} END"
    return f"""WITH RECURSIVE merges(l, r, rank) AS (VALUES {_values(rows)}), {_vocab(name)},
own AS ({own}), uniq AS (SELECT DISTINCT piece FROM own),
walk(piece, symbols) AS (
  SELECT piece, {symbols} FROM uniq
  UNION ALL
  SELECT piece, symbols[1:i - 1] || [symbols[i] || symbols[i + 1]] || symbols[i + 2:] FROM (
    SELECT w.piece, w.symbols, w.i, row_number() OVER (PARTITION BY w.piece ORDER BY m.rank, w.i) AS n
    FROM (SELECT piece, symbols, unnest(range(1, len(symbols))) AS i FROM walk) w JOIN merges m ON m.l = w.symbols[w.i] AND m.r = w.symbols[w.i + 1]) WHERE n = 1),
made AS (SELECT piece, arg_min(symbols, len(symbols)) AS symbols FROM walk GROUP BY piece),
tokens AS (SELECT doc_id, o, unnest(symbols) AS token, generate_subscripts(symbols, 1) AS k FROM own JOIN made USING (piece))
{select}"""


def _stretches(name: str) -> str:
    """Pieces of the stretches between added tokens, and the tokens as pieces of their own, in order."""
    plain, _ = _ahead(GPT2)
    out = []
    for g, part in enumerate(MARKED_TEXTS[name][1]):
        if part.startswith("<"):
            out.append(f"SELECT doc_id, ({g}, 0, 0) AS o, '{part}' AS piece FROM documents")
        else:
            inner = f"SELECT doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS c FROM (SELECT doc_id, {chunks(GPT2, f'({part})')} AS cs FROM documents)"
            out.append(f"SELECT doc_id, ({g}, c, p) AS o, piece FROM (SELECT doc_id, c, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM (SELECT doc_id, c, regexp_extract_all(chunk, {_text(plain)}, 0) AS ps FROM ({inner})))")
    return " UNION ALL ".join(out)


def _marked_pieces(marked: str) -> str:
    split = f"regexp_extract_all({marked}, '▁[^▁]*|[^▁]+', 0)"
    return f"SELECT doc_id, unnest({split}) AS piece, generate_subscripts({split}, 1) AS o FROM documents WHERE text <> ''"


_HEX = "list_transform(regexp_extract_all(hex(encode(c)), '..', 0), lambda h: '<0x' || h || '>')"
_CHARACTERS = {
    "unknown_apart": "list_transform(regexp_extract_all(piece, '(?s).', 0), lambda c: CASE WHEN regexp_full_match(c, '[▁milk]') THEN c ELSE '<unk>' END)",
    "unknown_fused": "list_transform(regexp_extract_all(piece, '[▁milk]|[^▁milk]+', 0), lambda c: CASE WHEN regexp_full_match(c, '[▁milk]') THEN c ELSE '<unk>' END)",
    "unknown_bytes": f"flatten(list_transform(regexp_extract_all(piece, '(?s).', 0), lambda c: CASE WHEN regexp_full_match(c, '[▁milk]') THEN [c] ELSE {_HEX} END))",
}
_CHARACTERS["prefixed"] = _CHARACTERS["unknown_bytes"]


def best_path(name: str, select: str) -> str:
    """``found`` (doc_id, o, path): the ids of each piece's best path, by a recursion over its places that keeps for each
    place the best sum, the ids on the way, and whether the last was unknown (unknown neighbours are one)."""
    d = definition(name)
    own = [(p, s) for p, s in d.scores if not p.startswith("<")]
    values = ", ".join(f"({_text(p)}, {s!r}::DOUBLE, '{d.vocab[p]}')" for p, s in own)
    unknown = min(s for _, s in d.scores) - 10.0
    ch = "substr(w.piece, w.pos + 1, 1)"
    if d.byte_fallback:
        table = "MAP {" + ", ".join(f"'{b:02X}': '{d.vocab[f'<0x{b:02X}>']}'" for b in range(256)) + "}"
        more = f"array_to_string(list_transform(regexp_extract_all(hex(encode({ch})), '..', 0), lambda h: {table}[h]), ' ')"
    else:
        more = f"CASE WHEN unknown[start + 1] THEN '' ELSE '{d.unk_id}' END"
    return f"""WITH RECURSIVE vocab(token, score, id) AS (VALUES {values}), own AS ({_marked_pieces(_MARKED)}), uniq AS (SELECT DISTINCT piece FROM own),
walk(piece, pos, sums, paths, unknown) AS (
  SELECT piece, 0, [0.0::DOUBLE], [''], [false] FROM uniq
  UNION ALL
  SELECT piece, pos + 1, list_append(sums, s), list_append(paths, trim(paths[start + 1] || ' ' || CASE WHEN u THEN {more.replace("w.", "")} ELSE id END)), list_append(unknown, u) FROM (
    SELECT *, row_number() OVER (PARTITION BY piece ORDER BY s DESC, start) AS r FROM (
      SELECT w.piece, w.pos, w.sums, w.paths, w.unknown, w.pos + 1 - l.len AS start, v.token IS NULL AS u, v.id, coalesce(v.score, {unknown!r}::DOUBLE) + w.sums[w.pos + 2 - l.len] AS s
      FROM walk w JOIN (SELECT unnest(range(1, {max(len(p) for p, _ in own) + 1})) AS len) l ON l.len <= w.pos + 1 LEFT JOIN vocab v ON v.token = substr(w.piece, w.pos + 2 - l.len, l.len)
      WHERE w.pos < length(w.piece) AND (v.token IS NOT NULL OR l.len = 1))) WHERE r = 1),
found AS (SELECT doc_id, o, paths[pos + 1] AS path FROM own JOIN walk USING (piece) WHERE pos = length(piece))
{select}"""


def word_parts(name: str, select: str) -> str:
    """``tokens`` (doc_id, o, k, token) by greedy longest matches over the distinct words."""
    d = definition(name)
    normal = f"lower(strip_accents(regexp_replace(regexp_replace(text, '[{SPACES}]', ' ', 'g'), '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]', '', 'g')))"
    split = f"regexp_extract_all({normal}, '[{PUNCT}]|[^{SPACES}{PUNCT}]+', 0)"
    longest = max(map(len, d.vocab))
    return f"""WITH RECURSIVE {_vocab(name)},
own AS (SELECT doc_id, unnest({split}) AS piece, generate_subscripts({split}, 1) AS o FROM documents), uniq AS (SELECT DISTINCT piece FROM own),
walk(piece, k, pos, token) AS (
  SELECT piece, 0, 1, '' FROM uniq WHERE length(piece) <= {d.max_chars}
  UNION ALL
  SELECT piece, k + 1, pos + len, token FROM (
    SELECT w.piece, w.k, w.pos, l.len, v.token, row_number() OVER (PARTITION BY w.piece, w.k ORDER BY l.len DESC) AS r
    FROM walk w JOIN (SELECT unnest(range(1, {longest + 1})) AS len) l ON w.pos + l.len - 1 <= length(w.piece)
    JOIN vocab v ON v.token = CASE WHEN w.pos = 1 THEN '' ELSE '##' END || substr(w.piece, w.pos, l.len)) WHERE r = 1),
whole AS (SELECT piece FROM walk WHERE pos = length(piece) + 1),
parts AS (SELECT piece, k, token FROM walk WHERE k > 0 AND piece IN (SELECT piece FROM whole) UNION ALL SELECT piece, 1, '[UNK]' FROM uniq WHERE piece NOT IN (SELECT piece FROM whole)),
tokens AS (SELECT doc_id, o, k, token FROM own JOIN parts USING (piece))
{select}"""


def _cleaned(token: str) -> str:
    for a, b in CLEAN_UP:
        token = f"replace({token}, {_text(a)}, {_text(b)})"
    return token


_LED = "CASE WHEN starts_with(text, ' ') THEN substr(text, 2) ELSE text END"
_SHOWN = f"CASE WHEN o = 1 AND k = 1 THEN {_cleaned('token')} WHEN starts_with(token, '##') THEN {_cleaned('substr(token, 3)')} ELSE {_cleaned(chr(39) + ' ' + chr(39) + ' || token')} END"
_FOUND = "SELECT doc_id, md5(string_agg(path, ' ' ORDER BY o)) AS h, sum(len(string_split(path, ' ')))::BIGINT AS n_tokens FROM found WHERE path <> '' GROUP BY doc_id"


def _plain(expression: str) -> str:
    return f"SELECT doc_id, md5({expression}) AS h FROM documents WHERE text <> ''"


def _path_text(known: str) -> str:
    """Unknown runs of a word are one unknown token, whose text is that."""
    return f"regexp_replace({_LED}, '[^{known} ]+', '<unk>', 'g')"


ENCODE = {
    "added_options": merged("added_options", _stretches("added_options"), f"CASE WHEN piece LIKE '<%>' THEN [piece] ELSE {_BYTE_SYMBOLS} END", IDS),
    "added_normalized": merged("added_normalized", _stretches("added_normalized"), f"CASE WHEN piece LIKE '<%>' THEN [piece] ELSE {_BYTE_SYMBOLS} END", IDS),
    "ignore_merges": merged("ignore_merges", covering_order(GPT2), _BYTE_SYMBOLS, IDS),
    **{n: merged(n, _marked_pieces(_MARKED if n != "prefixed" else _ALWAYS), c, IDS) for n, c in _CHARACTERS.items()},
    "best_path": best_path("best_path", _FOUND),
    "best_path_bytes": best_path("best_path_bytes", _FOUND),
    "words": word_parts("words", IDS),
}
DECODE = {
    "added_options": "SELECT doc_id, md5(lang || ' ' || ', ' || source || ' ' || lang || ' ' || source || '<one>') AS h FROM documents",
    "added_normalized": "SELECT doc_id, md5(source || '  ' || lang || '<caf' || chr(65533) || '> ' || source) AS h FROM documents",
    "ignore_merges": _plain("text"),
    "unknown_apart": _plain(f"regexp_replace({_LED}, '[^milk ]', '<unk>', 'g')"),
    "unknown_fused": _plain(f"regexp_replace({_LED}, '[^milk ]+', '<unk>', 'g')"),
    "unknown_bytes": _plain(_LED),
    "prefixed": _plain("text"),
    "best_path": _plain(_path_text("tea")),
    "best_path_bytes": _plain(_LED),
    "words": word_parts("words", f"SELECT doc_id, md5(string_agg({_SHOWN}, '' ORDER BY o, k)) AS h FROM tokens GROUP BY doc_id"),
}
