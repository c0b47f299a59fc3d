"""Template residue, filler and error pages instead of content.

Three detectors over the prose of a text (fenced code, quoted code spans and code lines are taken out first):

* slots: one grammar per delimiter finds unfilled placeholders.  A slot in code, inside quotes or in a sentence that
  speaks about templates is shown, not left over.  Of a slot in running prose the density decides: where a text
  shows ``SHOWN`` times as many slots as it has open ones, it teaches templates.  A slot that is a heading, a field's
  value or a whole line stands where the text's own words should stand and counts whatever the density;
* filler: paragraphs of dummy Latin (words of the classic passage among words of Latin make, without the function
  words of a living language) or of nothing but stock phrases, and texts that say one short sentence over and over;
* notices: texts of which every sentence is an error, block, script or removal notice, or the chrome around it.

The work is one pass of pure Python per text behind an Arrow batch; there is no shuffle and no state, so the
plan is the same at any size.  Null, empty and blank texts are no case, nor are merely short ones.  Repeated
rows give repeated results; other columns pass through untouched.
"""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The nouns that slots ask for, dummy Latin, stock phrases and notices.
SLOT_NOUNS = r"(?:title|name|author|url|link|description|version|date|email|e-mail|address|company|project|text|summary|year|month|phone|number|id|username|user|password|token|key|path|file|image|logo|licen[cs]e|owner|repo|repository|organi[sz]ation|website|domain|city|country|price|amount|label|heading|subtitle|content|value|abstract|keywords|contact|team|product)"
SLOTS = {
    "mustache": r"\{\{\{?\s*[#/^&>]?\s*[A-Za-z_][\w.$ |:'\"-]{0,60}?\s*\}?\}\}",
    "dollar": r"\$\{\s*[A-Za-z_][\w.:-]{0,60}\s*\}",
    "velocity": r"\$!\{?[A-Za-z_][\w.]{0,60}\}?",
    "hash": r"#\{\s*[A-Za-z_][\w.]{0,60}\s*\}",
    "erb": r"<%[=-]?\s*[A-Za-z_@][\w.\[\]'\" ]{0,60}\s*-?%>",
    "jinja": r"\{%-?\s*[A-Za-z_][\w. ]{0,60}\s*-?%\}",
    "brackets": r"\[\[\s*[A-Za-z_][\w .-]{0,40}" + SLOT_NOUNS + r"\s*\]\]|\[\[\s*" + SLOT_NOUNS + r"\s*\]\]",
    "percent": r"%%[A-Z][A-Z0-9_ ]{0,40}%%|%\([a-z_]\w{0,40}\)[sdr]",
    "at": r"@@[A-Z][A-Z0-9_]{0,40}@@",
    "dunder": r"(?<!\w)__(?!(?:FILE|LINE|DATE|TIME|FUNCTION|CLASS|METHOD|NAMESPACE|DIR|COUNTER|END|DATA|STDC|VA_ARGS|TIMESTAMP|PACKAGE|VERSION|GNUC|CPLUSPLUS)__)[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)",
    "crosses": r"\bX{3,}_[A-Z][A-Z0-9_]{0,40}_X{3,}\b",
    "angle": r"<(?:your|my|insert|enter|add|put|the)[-_ ][A-Za-z][\w -]{0,40}>|<[A-Z][A-Za-z _-]{0,40}\s(?:GOES\s)?HERE>",
    "insert": r"\[(?:INSERT|ENTER|ADD|YOUR|PUT|FILL IN|REPLACE|TYPE|CHANGE)\b[^\]\n]{0,50}\]|\[[A-Z][A-Z _-]{0,40}\s(?:GOES\s)?HERE\]",
}
SLOT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SLOTS.items()))
SLOT_HINT = re.compile(r"\{\{|\$\{|\$!|#\{|<%|\{%|\[\[|%%|%\(|@@|__[A-Z]|XXX_|<(?:your|my|insert|enter|add|put|the)[-_ ]| HERE[>\]]|\[(?:INSERT|ENTER|ADD|YOUR|PUT|FILL IN|REPLACE|TYPE|CHANGE)\b")
EXPLAINS = re.compile(
    r"\b(?:templat\w+|placeholders?|slots?\b|syntax|variables?|substitut\w+|expand(?:s|ed)?|render(?:s|ed)?|interpolat\w+|escap(?:e|es|ed|ing)|such as|for example|e\.g\.|literal(?:ly)?|replac(?:e|es|ed)|mustache|jinja|handlebars|"
    r"delimiters?|macros?|tokens? (?:like|such)|pattern|regex|write|spelled|notation|platzhalter|vorlage|marcador|plantilla|modèle|模板|占位)",
    re.I,
)
DUMMY_LATIN = frozenset(
    "lorem ipsum dolor amet consectetur consectetuer adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat "
    "duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim est laborum curabitur pellentesque habitant morbi tristique "
    "senectus netus malesuada fames turpis egestas vestibulum tortor quam feugiat vitae ultricies eget tempus aliquet mauris placerat eleifend leo quisque sapien ullamcorper pharetra condimentum rutrum nunc facilisis luctus "
    "metus ornare viverra tellus donec faucibus orci pulvinar lacus venenatis suscipit lectus ante dapibus diam posuere cubilia curae cras justo odio euismod semper porta integer nostrum".split()
)
LATIN_HINT = re.compile(r"\b(?:lorem|ipsum|dolor|amet|consectetu|adipiscing|eiusmod|incididunt|aliqu|nostru|ullamco|voluptat|cillum|pariatur|excepteur|occaecat|laborum|curabitur|pellentesque|vestibulum|feugiat|mauris|tempus|ultric|pulvinar|venenatis|euismod)")
#: Endings of Latin words; few words of a living language without its function words have them throughout.
LATIN_MADE = re.compile(r"[a-z]{2,}(?:um|us|am|em|im|is|os|as|es|it|at|et|nt|or|ur|ae|a|o|e|i)$")
#: Least share of such words in dummy Latin, and of classic ones; most function words; fewest words.
LATIN_SHARE, CLASSIC_SHARE, FUNCTION_SHARE, LATIN_WORDS = 0.7, 0.1, 0.12, 5
#: A text that shows so many slots for each open one teaches templates.
SHOWN = 3
STOPWORDS = frozenset("the of and to in is for that with on as are this by from or be at an it der die das und ist le la les des et est el los las que una il che di para por um het een och att som 的 が を".split())
STOCK = re.compile(
    r"^(?:(?:add|insert|put|enter|write|type|place|your|some|sample|dummy|example|placeholder|default|more|body|main|page|filler)\s+)*(?:your\s+)?(?:text|content|copy|description|title|words|paragraph|sentence|heading|placeholder|stuff)(?:\s+(?:goes\s+|to\s+go\s+|will\s+(?:go|be)\s+)?(?:here|text|content))?$|"
    r"^(?:coming (?:very )?soon|under construction|to be (?:written|added|done|completed|determined|announced|continued)|work in progress|content (?:coming|pending)(?: soon)?|watch this space|blah(?:[ ,]+blah)*|foo bar(?: baz)?|"
    r"(?:add|insert|write|enter|put|provide|fill in|type)\s+(?:(?:your|some|the|an?|more|here)\s+)*(?:content|text|description|details|something|anything|information|words|copy)\b.{0,50}|(?:describe|explain|introduce|summari[sz]e|tell us about)\s+(?:your|the|this|yourself)\b.{0,60}|"
    r"this (?:section|page|part|text|space|paragraph|chapter|document) (?:is|was|has been) (?:(?:intentionally|deliberately|currently|still) )*(?:left|reserved|blank|empty)\b.{0,60}|to be (?:filled|provided|supplied)\b.{0,40}|"
    r"texte à (?:venir|compléter|insérer|remplacer)|contenu à venir|(?:texto|contenido) (?:pendiente|por venir|de relleno)|(?:text|inhalt) folgt(?: in kürze)?|platzhalter(?:text)?|testo (?:in arrivo|segnaposto)|texto em breve|内容待补充|敬请期待|待添加|準備中|"
    r"(?:test|testing|text|asdf|qwerty|xxx+|tbd|tba|todo|lorem|ipsum|placeholder|dummy)(?:\s+(?:test|testing|text|asdf|qwerty|123|tbd|todo|ipsum|lorem))*|lorem ipsum(?: dolor(?: sit amet)?)?|this is (?:a |some |just )?(?:placeholder|dummy|sample|filler|test)(?: text| page| content)?|"
    r"(?:hier|ihr) (?:steht )?(?:ihr )?text(?: hier)?|votre texte ici|su texto aquí|tu texto aquí|texto de ejemplo|texte d'exemple|blindtext|beispieltext|在此处?(?:输入|填写|添加|插入|编辑)(?:您的|你的)?(?:文字|文本|内容|标题|描述|正文)?|占位(?:文本|文字|内容|符)|这里是(?:文字|文本|内容|标题)|ここに(?:テキスト|文章|内容)を?入力.{0,6}|hier (?:text|inhalt) (?:einfügen|eingeben)|(?:insérez|ajoutez) (?:votre |le )?texte ici|(?:escriba|inserte) (?:su |el )?texto aquí|inserisci(?: il)? testo(?: qui)?)$",
    re.I,
)
NOTICE = re.compile(
    r"javascript|(?:turn on|switch on|enable|allow|activate)\b.{0,20}\bscripts?\b|\bscripts? (?:are|is) (?:off|disabled|blocked|required|turned off)|too many requests|rate[- ]limit(?:ed)?\b|(?:bad|invalid|wrong|missing) (?:credentials|token|api key|password|signature)|^[45]\d\d$|\bcookies?\b.{0,60}\b(?:enable|accept|required|disabled|allow)|(?:enable|accept|allow)\b.{0,40}\bcookies|"
    r"\b[45]\d\d\b\W{0,3}(?:not found|forbidden|bad gateway|bad request|service (?:temporarily )?unavailable|internal (?:server )?error|unauthori[sz]ed|gateway time-?out|too many requests|gone|method not allowed|error)|\berror\W{0,3}(?:code\W{0,3})?[45]\d\d\b|"
    r"^(?:not found|forbidden|bad gateway|service unavailable|internal (?:server )?error|gateway time-?out|access denied|permission denied|unauthori[sz]ed|too many requests|page not found|file not found|404)$|"
    r"(?:page|site|file|document|resource|link|url|address|content|article|repository|project|account|profile|item)\b.{0,50}\b(?:not (?:be )?found|(?:is|was|are) (?:not|no longer|currently) (?:available|accessible|reachable)|(?:doesn'?t|does not|no longer) exists?|has been (?:removed|deleted|moved|disabled|suspended|archived|made private|taken down)|may have (?:been )?(?:moved|renamed|removed|deleted)|could not be|cannot be|can'?t be|is unavailable|isn'?t available)|"
    r"(?:can'?t|cannot|could not|couldn'?t|unable to) (?:find|locate|load|display|reach|open|connect)\b.{0,40}(?:page|site|file|server|resource|database|document|host|content)|"
    r"access (?:to .{0,40})?(?:is |was |has been )?(?:denied|blocked|restricted|forbidden)|(?:your|this) (?:ip|address|request|account|connection|access)\b.{0,40}\b(?:blocked|denied|suspended|banned|limited|rejected|flagged)|security (?:rule|check|policy|service)|"
    r"not a robot|are (?:you )?(?:a )?human|captcha|verif(?:y|ying|ication).{0,30}(?:human|browser|robot)|checking your browser|unusual traffic|ddos|"
    r"(?:down|closed|offline|unavailable|undergoing|scheduled)\b.{0,30}maintenance|maintenance mode|(?:temporarily|currently) (?:unavailable|offline|down|out of service)|check back (?:soon|later|again)|try again (?:later|soon|in)|please (?:wait|stand by|try again|retry|reload|refresh)|we(?:'ll| will) be (?:right )?back|"
    r"error establishing|database (?:connection|error)|connection (?:refused|reset|timed out|failure|closed)|upstream (?:connect|request|server)|reset before headers|reset reason|(?:server|request|gateway|operation) timed? ?-?out|"
    r"fatal error|uncaught (?:exception|error)|unhandled (?:exception|error)|stack trace|traceback \(most recent|^#?\d+ \S+\(\d+\)|^thrown\b|^at [\w.$/<>]+(?:\(| \()|segmentation fault|core dumped|something went wrong|an (?:unexpected )?error (?:has )?occurred|internal error|oops|whoops|"
    r"(?:sign|log) ?in to (?:view|continue|see|access|read)|(?:please|you must|need to) (?:sign|log) ?in|session (?:has )?(?:expired|timed out|ended)|(?:login|authentication|registration|subscription) (?:is )?required|"
    r"(?:removed|made private|taken down|suspended|deleted)\b.{0,60}|think this is (?:a |an )?(?:mistake|error)|contact (?:the |your )?(?:administrator|webmaster|owner|support|site)|write to the owners|"
    r"redirect(?:ing|ed)\b|you (?:are|will be) being redirected|click here if you are not|domain (?:is )?(?:for sale|parked|expired)|browser (?:is )?(?:not supported|out ?dated|too old)|unsupported browser|upgrade your browser|"
    r"启用|禁用|无法访问|页面不存在|找不到|未找到|访问被拒绝|验证码|请登录|维护中|稍后再试|aktivieren sie|nicht gefunden|zugriff verweigert|wartung|nicht verfügbar|activez|introuvable|accès refusé|maintenance|habilite|active el|no encontrad[ao]|acceso denegado|mantenimiento|no disponible|включите|не найдена|доступ запрещ|有効にして|見つかりません|abilita|non trovata|ative o",
    re.I,
)
JSON_NOTICE = re.compile(r"^\s*\{\s*\"?(?:message|error|errors|status|code|detail|title|reason|success|ok)\"?\s*:", re.I)
CHROME = re.compile(
    r"^(?:[\w .&-]{1,30}(?:\s*[>|»/·•]\s*[\w .&-]{1,30})+|(?:\(c\)|©|copyright)\s.{0,60}|(?:back|return|go|skip) to .{1,40}|loading(?:\.{0,3}|…)|sign in|log ?in|sign up|register|menu|home|search|contact|imprint|privacy|terms|about|help|next|previous|"
    r"[\w ]{1,20}[:#]\s*[\w.-]{1,60}|ref(?:erence)?\.? [\w-]{4,60}|powered by .{1,30}|all rights reserved|nginx(?:/[\d.]+)?|apache(?:/[\d.]+)?.{0,40}|cloudflare)$",
    re.I,
)
REPORTS = re.compile(
    r"\b(?:returns?|returned|raises?|raised|answers|responds?|clients?|handlers?|endpoints?|wrapped|skipped|status codes?|callers?|logs|logged|throws|catches|handled|parsers?|tests?|fix(?:ed|es)?|bug|changelog|documented|middleware)\b|^(?:added|fixed|changed|removed|deprecated|security)\s*:",
    re.I,
)
JSON_CODE = re.compile(r"\"(?:status|code|statusCode|error_code|errno)\"\s*:\s*\"?[45]\d\d\b|\"(?:error|success|ok)\"\s*:\s*(?:true|false|\")")
JSON_CONTENT = re.compile(r"\"(?:prompt|text|content|data|items)\"\s*:\s*[\"\[{]")
SENTENCE_END = re.compile(r"[.;!?。！？]$")
STOCK_HINT = re.compile(r"\bhere\b|coming|construction|to be |in progress|placeholder|sample|dummy|filler|watch this|blah|foo bar|asdf|qwerty|test\b|testing\b|tbd|todo|example|text|ejemplo|\bici\b|aquí|在此|这里|输入|占位|ここに|einfügen|eingeben|inserisci|content|describe|explain|introduce|summari|intentionally|left (?:blank|empty|for)|reserved|venir|pendiente|folgt|platzhalter|待|准备|準備|敬请")
#: Words of a text that may be one short sentence over and over; sentences without blanks between them are cut at their signs.
PARTS = re.compile(r"\S+?[.!?,;。！？](?=\S)|\S+")
#: Most words and characters of such a sentence.
REPEATED_WORDS, REPEATED_CHARS = 12, 80
#: A sentence is a notice if there is one for so many characters; longer ones are cut at the frames of a stack trace first.
NOTICE_CHARS = 400
FRAME = re.compile(r"\s+(?=at [\w.$/<>]+\(|#\d+ |File \\?\")")
#: Most words in a JSON notice beside its notices.
JSON_OTHER_WORDS = 90
JSON_STRING = re.compile(r"\"((?:[^\"\\]|\\.)*)\"(\s*:)?")
FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n(?:[\s\S]*?\n)?[ \t]*\1[^\n]*$|^[ \t]*(```+|~~~+)[^\n]*\n[\s\S]*\Z", re.M)
SPAN = re.compile(r"(`+)(?!`)(?:[^`\n]|(?!\1)`)+?\1")
QUOTED = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|«[^»\n]+»|(?<!\w)'[^'\n]+'(?!\w)")
MARKUP = re.compile(r"<(?!(?:your|my|insert|enter|add|put|the)[-_ ]|%)/?[a-z][^<>\n]*>")
CODE_LINE = re.compile(
    r"[;{}]\s*$|^\s*(?://|/\*|#!|--\s|@\w+\s*$)|^\s*(?:def|class|func|fn|pub|impl|let|const|var|return|if|for|while|import|from|use|package|public|private|static|export|async|end|else|elif|try|except|with|assert|raise|print|echo|export|struct|switch|case)\b.*[({:;=\])]\s*$|"
    r"^\s*[\w.\[\]\"'$]+\s*(?:=|\+=|-=|:=|<<)\s|^\s*[\w.]+\(.*\)\s*;?\s*$|^\s*[-\w]+:\s*\$\{\{|^\s*\$\s"
)
HEADING_OR_FIELD = re.compile(r"\s*(?:#{1,6}\s|=+\s|(?:[-*+>]\s+)?(?:\*\*|__)?[\w -]{1,40}:(?:\*\*|__)?\s*\S{0,3}(?:\{|\$|<|\[|%|@|#|_|X))")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
SENTENCES = re.compile(r"(?<=[.!?。！？])\s+|\n+|(?<=[。！？])")


def prose(text: str) -> str:
    """``text`` without fenced code, code spans and markup tags."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n", text)
    if "`" in text:
        text = SPAN.sub(" ", text)
    return MARKUP.sub("\n", text) if "<" in text else text


def unfilled_slots(text: str) -> list[str]:
    """The slots that stand where words of the text's own should stand."""
    if not SLOT_HINT.search(text):
        return []
    placed, running, shown = [], [], 0
    block = False
    body = prose(text)
    for line in body.split("\n"):
        bare = line.lstrip()
        inside, block = block, "*/" not in bare and (block or bare.startswith("/*"))
        if not SLOT_HINT.search(line):
            continue
        slots = [m.group() for m in SLOT.finditer(line)]
        if not slots:
            continue
        rest = SLOT.sub(" ", line)
        if inside and bare.startswith("*") or CODE_LINE.search(rest) or EXPLAINS.search(rest):
            shown += len(slots)
            continue
        quoted = " ".join(QUOTED.findall(line))
        open_ = [s for s in slots if s not in quoted]
        shown += len(slots) - len(open_)
        (placed if HEADING_OR_FIELD.match(line) or not WORD.search(rest) else running).extend(open_)
    if running and not placed:
        shown += sum(1 for _ in SLOT.finditer(text)) - sum(1 for _ in SLOT.finditer(body))  # those in fenced code and code spans
        if shown >= SHOWN * len(running):
            return []
    return placed + running


def repeated(text: str) -> str | None:
    """The short sentence that the text is made of, over and over, at any number of times."""
    first = [m.group() for m in islice(PARTS.finditer(text), REPEATED_WORDS + 1)]
    if first[:1] == [] or first[0] not in first[1:]:
        return None
    words = PARTS.findall(text)
    for n in range(1, min(REPEATED_WORDS, len(words) // 2) + 1):
        if len(words) % n == 0 and words[n] == words[0] and words[n:] == words[:-n]:
            unit = " ".join(words[:n])
            return unit if len(unit) <= REPEATED_CHARS and any(ch.isalpha() for ch in unit) else None
    return None


def dummy_latin(body: str) -> bool:
    """Whether a paragraph is made of Latin that says nothing."""
    words = [w.lower() for w in WORD.findall(body)]
    classic = [w for w in words if w in DUMMY_LATIN]
    if len(words) < LATIN_WORDS or len(set(classic)) < 2 or len(classic) < CLASSIC_SHARE * len(words):
        return False
    made = sum(1 for w in words if w in DUMMY_LATIN or LATIN_MADE.match(w))
    return made >= LATIN_SHARE * len(words) and sum(w in STOPWORDS for w in words) <= FUNCTION_SHARE * len(words)


def filler_paragraphs(text: str) -> list[str]:
    """Paragraphs of dummy Latin, and of nothing but stock phrases (of more than one word; headings are none)."""
    if unit := repeated(text):
        return [unit]
    low = text.lower()
    latin = LATIN_HINT.search(low) is not None
    if not latin and not STOCK_HINT.search(low):
        return []
    found = []
    for paragraph in re.split(r"\n\s*\n", prose(text)):
        body = paragraph.strip()
        if not body or body[0] == "#" and "\n" not in body:
            continue
        if latin and dummy_latin(body):
            found.append(body)
            continue
        parts = (s.strip(" .!:…\t*_>-。！？") for s in SENTENCES.split(body))
        said = False
        for s in parts:
            if s:
                if not STOCK.match(s):
                    break
                said = said or " " in s or not s.isascii()
        else:
            if said:
                found.append(body)
    return found


def is_notice(text: str) -> bool:
    """Whether the text opens with a notice (chrome may come first) and holds hardly anything else.

    Sentences that report on such messages (quoting them, or saying who returns or handles them) are content.
    """
    if JSON_NOTICE.match(text) and not JSON_CONTENT.search(text) and (JSON_CODE.search(text) or NOTICE.search(text)) and _json_words(text) <= JSON_OTHER_WORDS:
        return True
    # Most texts show in their first lines that they have content. Neither code nor markup is open across a line end but fences,
    # which run to the end of the part: what is content in the first lines is content of the whole.
    if len(text) > 3000 and _notices(text[: text.rfind("\n", 0, 1500) + 1]) is None:
        return False
    return bool(_notices(text))


def _json_words(text: str) -> int:
    """Words of the strings in a JSON text that are no notices."""
    said = (x for m in JSON_STRING.finditer(text) if not m[2] for s in re.split(r"\\[nrt]", m[1]) for f in FRAME.split(s) for x in SENTENCES.split(f))
    return sum(len(WORD.findall(x)) for x in map(str.strip, said) if not NOTICE.search(x))


def _is_notice_sentence(s: str) -> bool:
    return len(s) < NOTICE_CHARS and bool(NOTICE.search(s)) or len(s) >= NOTICE_CHARS and sum(1 for _ in NOTICE.finditer(s)) * NOTICE_CHARS > len(s)


def _notices(text: str) -> int | None:
    """The number of notices; None where there is content before the first, or too much beside them."""
    notices = other = 0
    for line in prose(text).split("\n"):
        for whole in SENTENCES.split(line.replace("&nbsp;", " ")):
            for s in FRAME.split(whole) if len(whole) >= NOTICE_CHARS else (whole,):
                s = s.strip(" \t#*>_-=|·•\u200b\ufeff")
                if not s or not any(ch.isalnum() for ch in s):
                    continue
                words = len(WORD.findall(s))
                json = JSON_NOTICE.match(s) and not JSON_CONTENT.search(s)
                if not json and (CHROME.match(s) or words <= 4 and len(s) <= 40 and not SENTENCE_END.search(s) and not NOTICE.search(s)):
                    continue
                if json and JSON_CODE.search(s) or _is_notice_sentence(s) and not REPORTS.search(s) and (json or not QUOTED.search(s)):
                    notices += 1
                    continue
                other += max(words, 1 + len(s) // 12)
                if not notices or other > 16:
                    return None
    return notices


def residue(text: str | None) -> str | None:
    """slot | filler | notice, or null for a text with content of its own."""
    if not text or not text.strip():
        return None
    if unfilled_slots(text):
        return "slot"
    if filler_paragraphs(text):
        return "filler"
    return "notice" if is_notice(text) else None


@F.pandas_udf(T.StringType())
def residue_kind(text: pd.Series) -> pd.Series:
    return pd.Series([residue(t) for t in text], dtype=object)


def with_residue(documents: DataFrame) -> DataFrame:
    """``documents`` with ``residue``: slot, filler, notice or null."""
    return documents.withColumn("residue", residue_kind("text"))
