"""The chains of ``functions.text`` in DuckDB's SQL, whose patterns have no look around.

Where a rule needs one, places are marked first: ``Z`` twice at each end of a word, or once where a match may end, so that
a match can take one mark and leave the other to its neighbour; marks go afterwards.
"""

from __future__ import annotations

from speechprep.functions import text as X

Z = "\U0010fffd"
#: White space and characters of words, as Java's patterns have them without and with ``(?U)``.
WS = r"\t-\r "
WS_U = WS + r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD, WORD_U = r"\pL\p{Nd}_", r"\pL\pM\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}"


_MARK = (rf"([{WORD}][{WORD}\p{{Mn}}]*)", rf"{Z}{Z}\1{Z}{Z}")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replaced(t: str, *steps: tuple[str, str]) -> str:
    """DuckDB's replacement of (pattern, replacement) one after the other, all places."""
    for pattern, replacement in steps:
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return t


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def when(t: str, pattern: str, f) -> str:
    """``f(t)`` where ``pattern`` occurs, a condition that only saves time."""
    return let(t, "g", f"CASE WHEN regexp_matches(g, {quoted(pattern)}) THEN {f('g')} ELSE g END")


def woven(t: str, pattern: str, one: str) -> str:
    """``t`` with each match ``m`` of ``pattern`` as the SQL ``one``."""
    p = quoted(pattern)
    pieces = f"list_transform(range(1, len(found) + 1), lambda i: string_split_regex(h, {p})[i] || list_transform([found[i]], lambda m: {one})[1])"
    return let(t, "h", let(f"regexp_extract_all(h, {p})", "found", f"array_to_string({pieces}, '') || string_split_regex(h, {p})[-1]"))


def at_words(t: str, *steps: tuple[str, str]) -> str:
    """Steps whose pattern has ``‖`` for the edge of a word and ``~`` where one may be inside."""
    return replaced(t, _MARK, *[(edges(pattern), replacement) for pattern, replacement in steps], (Z, ""))


def edges(pattern: str) -> str:
    return pattern.replace("~", f"{Z}*").replace("‖", Z)


def ci(word: str) -> str:
    """``word`` in any case of A to Z, and in no other letters that fold to these."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else {" ": f"[{WS}]+", ".": "[.]"}.get(c, c) for c in word)


def any_of(words) -> str:
    return "(?:" + "|".join(ci(w) for w in words) + ")"


def plain(steps) -> list[tuple[str, str]]:
    """Steps that need no more than Java's white space and groups spelled anew."""
    return [(p.replace("(?dm)", "(?m)").replace("(?d)", "").replace(r"[^\s", f"[^{WS}").replace(r"\s", f"[{WS}]").replace(r"\S", f"[^{WS}]"), r.replace("$", "\\")) for p, r in steps]


_ENDS = any_of(X.SILENT_ELEMENTS)
_THOUGHTS = (rf"(?s)<{ci('think')}(?:{ci('ing')})?>.*?</{ci('think')}(?:{ci('ing')})?>", "")
_EMPHASIS = (r"\*\*(.*?)\*\*|__(.*?)__|\*(.*?)\*|_(.*?)_", r"\1\2\3\4")
_SPACES = plain(X.SPACES)
_NUMBER = r"([0-9]+(?:~\.~[0-9]+)?)"


def _without_cards(t: str) -> str:
    """Again and again, as often as blocks can be nested."""
    card = rf"(?s)<{ci('div')}[^>]*[^>{WORD}]{ci('kg-card')}(?:[^>{WORD}][^>]*)?>.*?</{ci('div')}>"
    return when(t, ci("kg-card"), lambda g: f"list_reduce(list_prepend({g}, list_transform(range(length({g}) // 18 + 1), lambda k: '')), lambda a, b: {replaced('a', (card, ''))})")


def filtered(t: str) -> str:
    """``filter_silent``."""
    t = _without_cards(replaced(t, (rf"(?s)<{_ENDS}[^>]*>.*?</{_ENDS}>", "")))
    calls = (rf"(?m)^[ \t]*{any_of(X.CALL_OPENERS)}[^\n]{{0,120}}$".replace(f"[{WS}]+", " "), "")
    return replaced(t, *plain([*X.X3_CODE, *X.X4_TABLES, *X.X5_FOOTNOTES]), calls, *plain([*X.X7_SYMBOL_LINES, (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]))


def abbreviated(t: str) -> str:
    """``spoken_abbreviations``."""
    t = before_blanks(t, X.ABBREVIATIONS, f"(?:{Z}|$)")
    t = when(t, "P&L", lambda g: at_words(g, ("‖P~&~L‖", "profit and loss")))
    cases = " ".join(f"WHEN {quoted(a)} THEN {quoted(s)}" for a, s in X.ACRONYMS.items())
    return when(t, "|".join(X.ACRONYMS), lambda g: f"array_to_string(list_transform(regexp_extract_all({g}, {quoted(f'[{WORD_U}]+|[^{WORD_U}]+')}), lambda x: CASE WHEN x >= 'A' AND x < '[' THEN CASE x {cases} ELSE x END ELSE x END), '')")


def before_blanks(t: str, words: dict[str, str], after: str) -> str:
    """Abbreviations without a character of words before them; ``after`` may be a mark, which stands before each blank."""
    steps = [(rf"(^|[^{WORD_U}]){a.replace('.', '[.]')}{after}", rf"\1{s}") for a, s in words.items()]
    return when(t, "|".join(a.replace(".", "[.]") for a in words), lambda g: replaced(g, (f"([{WS_U}])", rf"{Z}\1"), *steps, (Z, "")))


def _numbers(t: str) -> str:
    t = when(t, f"/{any_of(X.UNITS)}", lambda g: at_words(g, *[(rf"/~{ci(u)}‖", f" per {u}") for u in X.UNITS]))
    t = when(t, "[0-9][xX%]", lambda g: at_words(g, (rf"‖{_NUMBER}[xX]‖", r"\1 times"), (rf"‖{_NUMBER}~%", r"\1 percent")))
    ordinal = "(?:" + "|".join(ci(e) for e in ("st", "nd", "rd", "th")) + ")"
    ordinals = [(rf"‖0*{n}{ordinal}‖", w) for n, w in enumerate(X.ORDINALS, 1)] + [(rf"‖([0-9]+){ordinal}‖", r"\1")]
    t = when(t, f"[0-9]{ordinal}", lambda g: at_words(g, *ordinals))
    t = when(t, "24/7", lambda g: at_words(g, ("‖24~/~7‖", "twenty-four seven")))
    months = "[" + ", ".join(quoted(m) for m in X.MONTHS) + "]"
    part = lambda k: f"string_split(replace(m, '{Z}', ''), '-')[{k}]"
    date = f"coalesce({months}[CAST({part(2)} AS INTEGER)], {part(2)}) || ' ' || regexp_replace({part(3)}, '^0([0-9])', '\\1') || ', ' || regexp_replace({part(1)}, '^0+([0-9])', '\\1')"
    return when(t, "[0-9]-[0-9]{2}-[0-9]", lambda g: f"replace({woven(replaced(g, _MARK), edges('‖0*[0-9]{1,4}~-~[0-9]{2}~-~[0-9]{1,2}‖'), date)}, '{Z}', '')")


def _amounts(t: str) -> str:
    t = at_words(t, *[(rf"\$~{_NUMBER}[{m}{m.lower()}]‖", rf"\1 {w} dollars") for m, w in X.MAGNITUDES.items()])
    return replaced(t, (r"([0-9])([^BMTKbmtk0-9]|$)", rf"\1{Z}\2"), (rf"\$([0-9]{{1,3}}(?:{Z}?,[0-9]{{3}})*(?:{Z}?\.[0-9]{{1,2}})?){Z}", r"\1 dollars"), (Z, ""))


def _unescaped(t: str) -> str:
    """``unescape``: the longest old name where a name has no ``;`` of its own."""
    table = "MAP {" + ", ".join(f"{quoted(n)}: {quoted(c)}" for n, c in X._NAMED.items()) + "}"
    number = "coalesce(CASE WHEN length(d) > 8 THEN 1114112 WHEN d[1] = 'X' THEN CAST('0x' || d[2:] AS BIGINT) ELSE CAST(d AS BIGINT) END, 0)"
    windows = "MAP {" + ", ".join(f"{n}: {quoted(c)}" for n, c in X._WINDOWS.items()) + "}"
    none = "n BETWEEN 1 AND 8 OR n BETWEEN 14 AND 31 OR n IN (11, 127) OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534"
    character = f"CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n BETWEEN 128 AND 159 THEN {windows}[CAST(n AS INTEGER)] WHEN {none} THEN '' ELSE chr(CAST(n AS INTEGER)) END"
    digits = "regexp_replace(upper(rtrim(m[3:], ';')), '^(X?)0*([0-9A-F])', '\\1\\2')"
    numeric = let(digits, "d", let(number, "n", character))
    bare = f"regexp_extract(m, '^&({'|'.join(X._BARE)})', 1)"
    named = let(bare, "b", f"coalesce({table}[m[2:]], CASE WHEN b <> '' THEN {table}[b] || m[length(b) + 2:] END, m)")
    return when(t, "&[A-Za-z#]", lambda g: woven(g, r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)", f"CASE WHEN m[2] = '#' THEN {numeric} ELSE {named} END"))


def normalized(t: str) -> str:
    """``normalize``."""
    blanks = rf"""[^{WS}<>"']+"""
    tags = ["p", "div", "br", "li", "ul", "ol", "h[1-6]", "tr", "td", "th", "section", "article", "nav", "header", "footer", "blockquote"]
    block = "(?:" + "|".join("[hH][1-6]" if x == "h[1-6]" else ci(x) for x in tags) + ")"
    t = replaced(filtered(t), *plain([*X._FRONT_MATTER, *X._IMAGES_AND_LINKS]), (f"{ci('http')}[sS]?://{blanks}|{ci('www')}\\.{blanks}", ""))
    t = when(t, "@", lambda g: at_words(g, (r"‖(?:~[A-Za-z0-9._%+\-])+~@(?:~[A-Za-z0-9.\-])+~\.~[A-Za-z]{2,}‖", "")))
    t = replaced(t, _EMPHASIS, *plain(X._HEADS_AND_QUOTES))
    t = when(t, "<", lambda g: replaced(at_words(g, (f"</?~{block}‖[^>]*>", " ")), X.X12_TAGS[1]))
    t = when(when(_unescaped(t), r"\$", _amounts), "[0-9/]", _numbers)
    return replaced(abbreviated(t), *_SPACES)


def cleaned(t: str) -> str:
    """``clean_for_speech``."""
    t = replaced(t, _THOUGHTS, (rf"[{WS}]*\[{ci('LONG_PAUSE')}\][{WS}]*", "\n\n"), (rf"[{WS}]*\[{ci('PAUSE')}\][{WS}]*", ", "))
    for sign, said in [*X.QUOTE_SIGNS.items(), *[(c, "") for c in X.DROPPED_SIGNS], *X.SIGNS.items()]:
        t = f"replace({t}, {quoted(sign)}, {quoted(said)})"
    t = replaced(t, ("[#*_~>`]+", ""), (rf"https?://[^{WS}]+", ""))
    # A mark after each dot before a blank, a word or the end.
    steps = [(rf"(^|[^{WORD_U}]){a[:-1].replace('.', f'[.]{Z}*')}[.]{Z}", rf"\1{s}") for a, s in X.SPEECH_ABBREVIATIONS.items()]
    some = "|".join(a.replace(".", "[.]") for a in X.SPEECH_ABBREVIATIONS)
    t = when(t, some, lambda g: replaced(g, (rf"[.]([{WS_U}{WORD_U}]|$)", rf".{Z}{Z}\1"), *steps, (Z, "")))
    return replaced(t, (r"([.!?]){3,}", r"\1"), *plain([(r"\(\s*\)|\[\s*\]|\{\s*\}", ""), *X.SPACES]))


def stripped(t: str) -> str:
    """``strip_artifacts``."""
    blank = r"[\t\x0B-\r ]+"
    opening = rf"(?m)^(?:(?:{'|'.join(ci(w) for w in X.OPENINGS[0][0])})|{ci('of')}{blank}{ci('course')}|{ci('got')}{blank}{ci('it')})\b[^\n]{{0,150}}\n\n?"
    row = lambda phrase: blank.join(any_of(place) for place in phrase)
    about = rf"(?m)^(?:{'|'.join(row(p) for p in X.ABOUT_LINES)})\b[^\n]*"
    remark = rf"[{WS}]*\n(?:{'|'.join(row(p) for p in X.CLOSINGS)})\b[^\n]*$"
    t = replaced(t, _THOUGHTS, (opening, ""), (about, ""), (f"^[{WS}]+|[{WS}]+$", ""))
    return let(t, "x", f"CASE WHEN length(regexp_extract(x, '[^\\n]*$')) <= 265 THEN {replaced('x', (remark, ''))} ELSE x END")


def _in(x: str, words) -> str:
    return f"{x} IN ({', '.join(quoted(w.lower()) for w in words)})"


def _figures(t: str) -> str:
    found = f"regexp_extract_all({t}, {quoted(rf'[$][0-9,.]+|[0-9]+(?:[.][0-9]+)?(?:%|[{WS}]*[A-Za-z_][0-9A-Za-z_]*)?|[0-9A-Za-z_]+')})"
    whole = "split_part(regexp_extract(x, '^[0-9.]+'), '.', 1)"
    amount = f"x[1] = '$' OR x[-1] = '%' OR {_in("lower(regexp_extract(x, '[A-Za-z_][0-9A-Za-z_]*$'))", X.MAGNITUDES.values())}"
    return f"list_transform(list_filter({found}, lambda x: regexp_matches(x, '^[$0-9]')), lambda x: CASE WHEN {amount} THEN trim(x, ' ') WHEN NOT regexp_matches(x, '^[0-9.]+[A-Za-z_]') AND length({whole}) = 4 THEN {whole} END)"


def _dates(t: str) -> str:
    found = f"regexp_extract_all({t}, {quoted(rf'[0-9]+(?:[/-][0-9]+)*|[0-9A-Za-z_]+|[^0-9A-Za-z_{WS}]')})"
    is_ = lambda x, p: f"regexp_full_match({x}, {quoted(p)})"
    year = "(CASE WHEN k[i + 2] = ',' THEN k[i + 3] ELSE k[i + 2] END)"
    named = [x for d in X.WEEKDAYS for x in (d, d[:3])] + X.DAYS
    one = f"""CASE WHEN {_in('lower(k[i])', X.MONTHS)} AND {is_('k[i + 1]', '[0-9]{1,2}')} AND {is_(year, '[0-9]{4}')} THEN k[i] || ' ' || k[i + 1] || CASE WHEN k[i + 2] = ',' THEN ', ' ELSE ' ' END || {year}
  WHEN {is_('k[i]', '[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}')} OR {is_('lower(k[i])', '(?:q[1-4]|fy)[0-9]{2,4}')} OR {_in('lower(k[i])', named)} THEN k[i]
  WHEN ({_in('lower(k[i])', X.QUARTERS)} AND {is_('k[i + 1]', '[0-9]{2,4}')}) OR (lower(k[i]) IN ('last', 'next') AND {_in('lower(k[i + 1])', X.PERIODS)}) THEN k[i] || ' ' || k[i + 1] END"""
    return let(found, "k", f"list_transform(range(1, len(k) + 1), lambda i: {one})")


def entities(t: str) -> str:
    """The values of ``entities``, in any order, with nulls between them."""
    quotes = f"list_filter(list_transform(regexp_extract_all({t}, '\"([^\"]{{4,}})\"', 1), lambda x: trim(x, ' ')), lambda x: x <> '')"
    names = f"regexp_extract_all({t}, {quoted(rf'[a-z,;:] ([A-Z][a-z]+(?:[{WS}]+[A-Z][a-z]+)+)')}, 1)"
    single = f"regexp_extract_all(replace({t}, ' ', '  '), ' (?:{'|'.join(X.BEFORE_NAMES)})  ([A-Z][a-zA-Z]{{3,}})[ ,.;:!?]', 1)"
    return f"flatten([{_figures(t)}, {_dates(t)}, {quotes}, {names}, {single}])"
