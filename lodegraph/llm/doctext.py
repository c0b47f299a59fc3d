"""What a documentation comment tells: comment markers, tags, tool marks, placeholders, legal text, code and
restatements of the name are taken off; the content words that stay are the description.

A docstring is telling if at least one content word stays (or four characters of a script written without
spaces) that is neither in the function's name nor in a parameter's.  What a return or throws tag says counts
likewise, its types aside; what is said of a single parameter does not.
"""

from __future__ import annotations

import re

from lodegraph.llm.islands import parameters

# Words and phrases that mark what a comment says to tools, to readers or to nobody.
TOOL_MARK = re.compile(
    r"^(?:noqa|no ?lint|nolint\w*|pylint|eslint|tslint|jshint|jslint|stylelint|rubocop|swiftlint|phpcs|flake8|mypy|pyright|type:\s*ignore|clang-format|clang-tidy|prettier-|istanbul|c8 ignore|v8 ignore|"
    r"pragma\b|coverage:|codecov|nosec|nosonar|fmt:\s*(?:on|off)|isort:|yapf:|black:|ktlint|checkstyle|spotless|cspell|spell-?checker|webpack\w*:|vim:|-\*-|#?region\b|#?endregion\b|mark:|@ts-|@formatter|"
    r"suppress|language=|go:\w+|\+build|shellcheck|hadolint|sourcery|lint:|biome-|deno-|gosec|golint|revive:|staticcheck|rustfmt|clippy)",
    re.I,
)
LEGAL = re.compile(
    r"^\W*(?:copyright\b|\(c\)\s|©|spdx-)|licensed under|all rights reserved|subject to the (?:terms|licen[cs]e)|you may not use this|except in compliance with|without warrant|as is\W+ without|"
    r"redistribution and use|permission is hereby|see (?:the )?licen[cs]e|released under the|distributed under|part of the .{1,40} project, under|gnu (?:lesser |affero )?general public|proprietary and confidential|trade ?marks?\b.{0,30}(?:owner|property)",
    re.I,
)
REMINDER = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|tba|wip|bug|optimi[sz]e|review)\b(?:\s*\([^)]*\))?\s*:?", re.I)
PARAM_TAG = re.compile(r"^(?:[@\\](?:param|arg|argument|tparam|typeparam|type|rtype|template)\b|:(?:param|arg|argument|type|rtype|key|keyword)\b[^:]*:)", re.I)
RESULT_TAG = re.compile(r"^(?:[@\\](?:return|returns|retval|result|yields?)\b|:(?:return|returns|yields?)\b[^:]*:)\s*(?:\{[^}]*\}\s*)?", re.I)
THROWS_TAG = re.compile(r"^(?:[@\\](?:throws?|exception|raises?)\b|:raises?\b)\s*(?:\{[^}]*\}\s*)?[\w.]*:?\s*", re.I)
PARAM_HEAD = re.compile(r"^(?:args?|arguments?|params?|parameters?|keyword args?|parameter|paramètres|parámetros|参数)\s*:\s*(.*)$", re.I)
RESULT_HEAD = re.compile(r"^(?:returns?|return value|raises?|throws|yields?|rückgabe|返回)\s*:\s*", re.I)
TELLING_TAG = re.compile(r"^[@\\](?:brief|desc|description|summary|remarks?|note|details|doc|overview|par|short|abstract)\b\s*", re.I)
OTHER_TAG = re.compile(r"^[@\\]\w[\w.-]*")
FIELD_TAG = re.compile(r"^:\w[^:]*:")
SIGNED = re.compile(
    r"^\W*(?:(?:created|written|added|generated|changed|modified|updated|authored?|last (?:change|modified|edited|updated)|date|since|version|revision|rev\.?|v)\b(?:[\s:]+(?:on|by|at|in|the|since|with))*[\s:]*)?[\w.@<>-]*,?\s*(?:\d{1,4}[-/.]\d{1,4}(?:[-/.]\d{1,4})?)\W*$"
    r"|^\W*(?:created|written|added|generated|changed|modified|updated|authored?|maintained|owned|stub|reviewed)\s+(?:by|with|in|from)\s+(?:the\s+)?[\w.@<>-]+(?:\s+[\w.@<>-]+)?\W*$",
    re.I,
)
PLACEHOLDER = re.compile(
    r"^\W*(?:(?:please\s+)?(?:no|missing|add|enter|write|insert|put|provide|fill in|describe|empty|your|some|short|brief|sample|default|needs?|lacks?)\s+)*(?:an?\s+|the\s+|your\s+|some\s+)*(?:method\s+|function\s+|class\s+|api\s+)?"
    r"(?:description|descriptions|docs?|documentation|summary|comments?|docstring|javadoc|jsdoc|text|explanation|details|this|me)"
    r"(?:\s+(?:here|goes|go|missing|needed|pending|to come|to follow|later|of|for|the|this|an?|yet|is|not|available|function|method|placeholder|tbd|todo))*\W*$"
    r"|^\W*(?:(?:\w+[- ])?(?:auto[- ]?)?generated\s+(?:\w+\s+)?stub|(?:method|function)?\s*stub(?:\s+\w+){0,5}|stub created by.*|n/?a|none|null|nil|undocumented|not documented(?: yet)?|not yet documented|to be (?:documented|done|written|completed|defined)|placeholder|document(?: this| me)?|"
    r"self[- ]explanatory|see (?:above|below|name|code|source|implementation)|as above|ditto|same as above|foo|bar|baz|asdf\w*|lorem ipsum.*|test|blah.*|"
    r"beschreibung fehlt|keine beschreibung|fehlt noch|noch zu (?:dokumentieren|beschreiben)|à (?:compléter|faire|documenter|remplir)|description manquante|sans description|non documentée?|"
    r"pendiente(?: de .*)?|por (?:documentar|hacer|completar)|sin (?:descripción|documentar)|a completar|falta (?:la )?descripci[oó]n|da completare|descrizione mancante|falta descri[cç][aã]o|sem descri[cç][aã]o|"
    r"待补充|待完善|待定|暂无(?:描述|说明)?|无描述|未完成|说明待补|補足予定|未記入|説明なし|나중에|설명 없음|описание отсутствует|нет описания|заполнить)\W*$",
    re.I,
)
CODE = re.compile(
    r"^(?:[}\])]+[;,]?|(?:\}\s*)?(?:return|if|for|while|else|elif|switch|case|try|catch|finally|import|from|using|var|let|const|def|func|fn|function|public|private|static|class|struct|throw|raise|assert|end|begin)\b.*[;{}:)\]]|"
    r"(?:end|else|begin|pass|break;?|continue;?)|\w[\w.$]*(?:\[[^\]]*\]|\(\))*\s*(?:[-+*/%|&^]?=|:=|<<=?|>>=?)\s*[^=\s].*|(?:\w+(?:\.|::|->))*\w+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*;?|.*[;{]|[\w.]+\s*->\s*[\w.]+\(.*)$"
)
#: Words that say nothing by themselves about what a function does.
EMPTY_WORDS = frozenset(
    "a an the this that these those of to for and or is are was be been it its in on at by with from as into method methods function functions func fn routine procedure helper helpers class object code "
    "does do did will can may api internal private public protected static deprecated override inherit inherits inheritdoc see also note returns return param params parameter parameters argument arguments arg args value "
    "todo fixme description docs doc documentation summary stub generated auto here missing add write above below result results output nothing void true false null none nil "
    "overridden overrides constructor destructor getter setter accessor mutator util utils utility misc stuff thing things something implementation implements self".split()
)
MARKERS = re.compile(r"^\s*(?:/\*+!?|\*+/|//+!?|#+!?(?!\w)|--+|;+|\*+(?!\w)|\"\"\"|'''|=begin|=end|<!--|%+)?\s*")
ENDINGS = re.compile(r"\s*(?:\*+/|\"\"\"|'''|-->)\s*$")
TAGS = re.compile(r"</?[A-Za-z][^<>]{0,120}/?>|\{@\w+[^{}]*\}|&[a-z]+;")
HUMP = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_A-Za-z]+")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
SENTENCE = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？])")
UNSPACED = re.compile(r"[぀-ヿ㐀-鿿가-힣฀-๿]")


def stem(word: str) -> str:
    for end in ("ies", "ing", "es", "ed", "s"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: -len(end)]
            break
    return word[:-1] if len(word) > 3 and word[-1] in "ey" else word[:-1] if len(word) > 4 and word[-1] == word[-2] else word


def name_stems(*names: str | None) -> set[str]:
    return {stem(w.lower()) for n in names if n for w in HUMP.findall(n)}


def description(docstring: str | None) -> str:
    """The sentences of ``docstring`` that are neither marks, placeholders, code nor legal text; '' if none."""
    return " ".join(x for part in _told(docstring) for x in part).strip()


def _told(docstring: str | None) -> tuple[list[str], list[str]]:
    """The sentences about the function, and those of its return and throws tags."""
    kept: list[str] = []
    results: list[str] = []
    if not docstring:
        return kept, results
    in_params = in_list = in_results = False
    for raw in docstring.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = ENDINGS.sub("", MARKERS.sub("", raw))
        line = TAGS.sub(" ", line).strip()
        if not line:
            in_params = in_list = in_results = False
            continue
        if not any(ch.isalpha() for ch in line):
            continue
        if PARAM_HEAD.match(line) or PARAM_TAG.match(line):
            in_params, in_results = bool(PARAM_HEAD.match(line)), False
            continue
        if m := RESULT_TAG.match(line) or THROWS_TAG.match(line) or RESULT_HEAD.match(line):
            in_params, in_results = False, True
            line = line[m.end() :]
            if not any(ch.isalpha() for ch in line):
                continue
        elif in_results and line[0] in "@\\:":
            in_results = False
        if in_params:
            if re.match(r"^[\w.*$]+(?:\s*\([^)]*\))?\s*:", line) or raw[:1] in " \t":
                continue
            in_params = False
        if m := TELLING_TAG.match(line):
            line = line[m.end() :]
        elif OTHER_TAG.match(line) or FIELD_TAG.match(line):
            continue
        if in_list and re.match(r"^[-*•]\s", raw.strip(" */#")):
            continue
        in_list = False
        if TOOL_MARK.match(line) or LEGAL.search(line) or SIGNED.match(line) or PLACEHOLDER.match(line) or CODE.match(line) or re.fullmatch(r"[=\-~*_#+.\s]{3,}.{0,40}[=\-~*_#+.\s]{3,}", line):
            continue
        said = False
        for part in SENTENCE.split(line):
            if REMINDER.match(part):
                in_list = True
                continue
            if part and not PLACEHOLDER.match(part) and not CODE.match(part):
                (results if in_results else kept).append(part)
                said = True
        in_list = in_list and not said
    return kept, results


def _new_words(text: str, name: str | None, known: set[str]) -> bool:
    if len(UNSPACED.findall(text)) >= 4:
        return True
    for word in WORD.findall(text):
        low = word.lower()
        if low in EMPTY_WORDS or name and low == name.lower() or stem(low) in known:
            continue
        parts = [p.lower() for p in HUMP.findall(word)]
        if not all(stem(p) in known or p in EMPTY_WORDS for p in parts):
            return True
    return False


def telling(docstring: str | None, name: str | None, signature: str | None, language: str | None = None) -> str:
    """The description where it says something beyond the function's and its parameters' names, else ''."""
    kept, results = _told(docstring)
    if not kept and not results:
        return ""
    names = name_stems(name, *parameters(signature, name, language)) | {stem(w.lower()) for n in (name,) if n for w in re.findall(r"[A-Za-z]+", n)}
    if kept and _new_words(" ".join(kept), name, names):
        return " ".join([*kept, *results])
    types = name_stems(*re.findall(r"[A-Za-z_]\w*", signature or ""))
    if results and _new_words(" ".join(results), name, names | types):
        return " ".join([*kept, *results])
    return ""
