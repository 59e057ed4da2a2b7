"""Sentence units across languages and scripts.

Method: a text is cut into blocks (paragraphs, headings, list items); within a block every mark
that may close a sentence, and in scripts that write none every space, is a candidate, and semi-
Markov dynamic programming chooses the spans of every block: the score of a span adds its length, its
closing word, the opening word of the next one, and whether its quotation marks and brackets are
balanced. It is linear in the candidates: what a span's length is worth doesn't change beyond
LONGEST, so that of all earlier beginnings only the best one of each state of quotations is kept.

Two things are learned from all texts at each run (``fit``): abbreviations of any language, words that
have their full stop nearly always and hardly ever at the end of a paragraph; and, for scripts without
marks (Thai), how often a run of letters begins a block against how often it follows a space within
one, for the first letters of several lengths, the longer ones smoothed by the shorter. The word lists
below are what is known beforehand.

Defined results
---------------
* Null, empty and blank texts give no unit; nor do fenced code, rules and underlines of headings.
* An unclosed quotation or bracket doesn't hold the rest of its block together.
* A unit needs a letter or a digit. Offsets are code points. Repeated documents give repeated units.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut

RAREST = 1e-5  # share of all counts below which nothing is learned; so at most 100,000 keys are kept
PREFIXES = (3, 4, 6, 8, 12)  # letters that stand for an opening word in a script without spaces between words
SMOOTHING = 1.0  # how many counts the shorter prefix is worth
LEAST_STOPS = 14.0  # full stops of a word that chance would put at the end of a paragraph: exp(-14) is 1e-6
UNBALANCED = 50.0
LONGEST = 400  # characters beyond which a span's length is worth the same
USUAL = {"spaced": 80.0, "unspaced": 60.0, "cjk": 30.0}  # characters of a usual span
CLEAR, LIKELY, DOUBTFUL, UNLIKELY, NEVER = 2.5, 1.5, -0.5, -2.0, -99.0

SPACED_SCRIPT = "฀-๿຀-໿"  # sentences are divided by spaces

# Words before a full stop that isn't an end: always, before numbers, and unless an opening word follows.
TITLES = frozenset(
    "dr mr mrs ms mx prof rev hon st sr sra srta dra dres hr fr frl mme mlle mm m messrs gen sen rep capt lt sgt gov dipl ing"
    " проф акад г-н г-жа им ул д د أ م डॉ श्री प्रो ดร นพ พญ รศ ผศ ศ".split()
)
JOINERS = frozenset(
    "vs cf vgl ca e.g i.e z.b d.h u.a o.ä z d h bzw sog inkl exkl ggf evtl approx resp incl viz see esp p.ej p.ex p.e ej"
    " ex av т.е т е см ср напр".split()
)
BEFORE_NUMBERS = frozenset("no nos nr nrs núm num fig figs abb p pp pg pág págs pag s vol ch chap sec sect art abs col cols eq tab l ll рис стр гл табл п разд n".split())
MAY_END = frozenset("etc usw u.s u.k u.n e.u a.m p.m др т.д т.п al inc ltd co corp jr bros с ч г кг мин сек".split())
# Titles and the like in the case given: in another one they are words that end sentences.
CASED = frozenset(
    "sig Sig bijv Bijv np Pvt Assn Pr Sta Sto Dott Avv Dhr dhr Mevr mevr Drs blz inż św tzn tj ok wg Maj Cpl Cmdr Gov Dept Univ Mgr Exmo Exma Profa".split()
)
ORDINAL_BEFORE = frozenset("am im beim zum vom zur der dem den des das die ab seit bis jeder jedem".split())
OPENING_WORDS = frozenset("the a an this that these those it we he she they i you our his her their one every some no if when after before in on at as but and".split())

_OPENERS, _CLOSERS = "“„«「『‹（([【《〈‘\"", "”“»」』›）)]】》〉’\""
_QUOTES = frozenset("“”„«»「」『』‹›\"")
_MARK = re.compile(r'["“”„«»「」『』‹›()（）\[\]【】]|[。！？।॥۔．｡။។…]+[!?]*|[.!?…؟]+')
_EMOJI = re.compile("(?:[ \t]|\n(?=\\S))?(?:[\U0001F000-\U0001FAFF☀-➿⭐⭕⌚-⏿][️‍\U0001F3FB-\U0001F3FF]*)+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]")
_SPACED = re.compile(f"[{SPACED_SCRIPT}]")
_CASELESS = re.compile("[֐-ࣿऀ-໿ᄀ-ᇿ぀-㆏㐀-鿿가-힯豈-﫿]")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿＀-￯]")
_IDENTIFIER = re.compile(r"[./\\_(){}:`@=]|[a-z][A-Z]|\d")
_TRAIL = ".,;:!?…)]}»”“\"'’"
_LINE = re.compile(r"[ \t]*((?:>[ \t]*)*)(?:(#{1,6})(?:[ \t]+|$)|([-*+•‣◦▪–])[ \t]+|(\d{1,3})[.)][ \t]+)?")
_RULE = re.compile(r"[ \t>]*(?:=+|-{2,}|\*{3,}|_{3,}|(?:[-*_][ \t]+){2,}[-*_])[ \t]*$")
_FENCE = re.compile(r"[ \t>]*(`{3,}|~{3,})")
_GLUED = re.compile(r"[^\W\d_A-Z]\)?[.!?]([^\W\d_a-z][^\W\d_]*)$")
_PLAIN_FIRST = re.compile(r"[^\W\d_]|[./`(\"“„«「¿¡（]")


def blocks(text: str) -> tuple[str, list[tuple[int, int, bool]]]:
    """The text with its marks blanked (same length), and (start, end, is heading) of each block."""
    out: list[tuple[int, int, bool]] = []
    pieces: list[str] = []
    begin = at = 0
    open_block = fence = None
    last_number = None

    def close(end: int, heading: bool = False) -> None:
        nonlocal open_block
        if open_block is not None:
            out.append((open_block, end, heading))
            open_block = None

    for line in text.split("\n"):
        end = at + len(line)
        if fence is not None:
            m = _FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end():].strip():
                fence = None
        elif not line or line.isspace():
            close(at)
            last_number = None
        elif _PLAIN_FIRST.match(line) and not line.startswith("```"):
            if open_block is None:
                open_block = at
        elif m := _FENCE.match(line):
            close(at)
            fence = m[1]
        elif _RULE.match(line):
            close(at, heading=True)  # an underline, or a rule between paragraphs
        else:
            m = _LINE.match(line)
            mark = m.end()
            if m[4] is not None and open_block is not None and last_number is None and m[4] != "1":
                mark = m.end(1)  # a wrapped line that happens to begin with a number
                m = None
            if m is not None and m[2] is not None:
                close(at)
                out.append((at + mark, end, True))
                last_number = None
            elif m is not None and (m[3] is not None or m[4] is not None):
                close(at)
                open_block = at + mark
                last_number = m[4] or last_number
            elif open_block is None:
                if mark < len(line):
                    open_block = at
            elif not line[mark:].strip():
                close(at)
            if mark and ">" in line[:mark] or m is None and mark:
                pieces.append(text[begin:at])
                pieces.append(" " * mark)
                begin = at + mark
        at = end + 1
    close(len(text))
    pieces.append(text[begin:])
    return "".join(pieces), out


def _next_class(text: str, at: int, end: int) -> str:
    """What the text at ``at`` opens with: end, upper, lower, name, caseless, joint or other."""
    while at < end and text[at] in "\"“„«‹「『（([¿¡*_ \t'‘":
        at += 1
    if at >= end:
        return "end"
    c = text[at]
    if c == "`" or c == "." and at + 1 < end and text[at + 1] in "./":
        return "name"
    if c.isdigit() or c.isupper() or c.istitle():
        return "upper"
    if c.islower():
        stop = at
        while stop < end and not text[stop].isspace():
            stop += 1
        return "name" if _IDENTIFIER.search(text[at:stop].rstrip(_TRAIL)) else "lower"
    if c in ",;:，、；：":
        return "joint"
    return "caseless" if _CASELESS.match(c) else "other"


def _word_before(text: str, start: int, at: int) -> tuple[str, int]:
    first = at
    while first > start and not text[first - 1].isspace() and text[first - 1] not in "(（[«„“\"「'?!。！？":
        first -= 1
    return text[first:at], first


def _full_stop(text: str, start: int, at: int, after: int, end: int, spaced: bool, kind: str, learned: frozenset[str]) -> float:
    """The score of a sentence that closes with the full stop at ``at``."""
    word, first = _word_before(text, start, at)
    if (glued := _GLUED.search(word)) and glued[1][0].isupper():  # the space after the sentence before it is missing
        word = glued[1]
        first = at - len(word)
    low = word.lower()
    if kind == "joint":
        return NEVER
    if not word:
        return CLEAR if spaced and kind != "lower" else NEVER
    if not spaced:
        if len(word) == 1 and word.isupper():
            return NEVER
        nxt = text[after]
        if _CASELESS.match(word[-1]) and (_CASELESS.match(nxt) or nxt.isupper()):
            return LIKELY if not _CJK.match(nxt) or not _CJK.match(word[-1]) else CLEAR
        stop = after
        while stop < end and text[stop].isalpha():
            stop += 1
        tail = text[stop:stop + 1]
        if nxt.isupper() and (text[after + 1:stop].islower() or stop == after + 1) and (not tail or tail.isspace() or tail in ",'’"):
            return CLEAR if word[-1].isalnum() or word[-1] in ")`" else NEVER
        return NEVER
    if len(word) == 1 and word.isupper() and not _ends_in_number(text, start, first):
        return NEVER  # an initial
    if word in CASED:
        return NEVER
    if low in JOINERS or low in TITLES:
        if len(low) == 1 and first > start and _ends_in_number(text, start, first):
            return CLEAR if kind in ("upper", "name") else UNLIKELY
        return NEVER
    if low in BEFORE_NUMBERS:
        nxt = text[after]
        if len(low) == 1 and _ends_in_number(text, start, first):
            return CLEAR if kind != "lower" else UNLIKELY
        return NEVER if nxt.isdigit() or kind == "lower" else CLEAR
    if low in MAY_END or (len(low) == 1 and low == word and word.isalpha() and _ends_in_number(text, start, first)):
        if low in ("u.s", "u.k", "u.n", "e.u"):
            nxt = re.match(r"\w+", text[after:after + 20])
            return CLEAR if nxt and nxt[0].lower() in OPENING_WORDS and nxt[0][0].isupper() else UNLIKELY
        return CLEAR if kind in ("upper", "name", "other") else UNLIKELY
    if len(word) == 1 and word.isalpha() and not _CASELESS.match(word):
        return NEVER  # an initial
    if low in learned and (len(low) <= 3 or kind != "upper"):
        return UNLIKELY  # a longer word before a capital may still be what closes a sentence
    if word.isdigit() and len(word) <= 3 and kind == "upper":
        before, _ = _word_before(text, start, len(text[start:first].rstrip()) + start)
        if before.lower() in ORDINAL_BEFORE:
            return NEVER
    if kind == "lower":
        return DOUBTFUL if "." in word or len(word) < 2 else LIKELY
    return CLEAR


def _ends_in_number(text: str, start: int, at: int) -> bool:
    before, _ = _word_before(text, start, len(text[start:at].rstrip()) + start)
    return bool(before) and before[-1].isdigit()


def candidates(text: str, start: int, end: int, openers: dict[str, float] | None, learned: frozenset[str] = frozenset()):
    """[(end, score, state)] of a block, by end, and the state of quotations and brackets at its end."""
    found: list[tuple[int, float, tuple[int, int, int]]] = []
    straight = quotes = brackets = 0
    skip = start
    states: list[tuple[int, tuple[int, int, int]]] = [(start, (0, 0, 0))]
    for m in _MARK.finditer(text, start, end):
        at = m.start()
        c = text[at]
        if c in _QUOTES or c in "()（）[]【】":
            if c == '"':
                straight ^= 1
            elif c in "“" and quotes > 0 and (at + 1 >= end or not text[at + 1].isalnum()):
                quotes -= 1  # closes „
            elif c in "„«「『‹“":
                quotes += 1
            elif c in "”»」』›":
                quotes -= 1 if quotes else 0
            elif c in "(（[【":
                brackets += 1
            else:
                brackets -= 1 if brackets else 0
            states.append((m.end(), (straight, quotes, brackets)))
            continue
        stop = m.end()
        if at < skip or (c == "." and stop < end and text[stop].islower() and stop - at == 1):
            continue
        mark = m[0]
        closed_quote = closed = False
        s, q, b = straight, quotes, brackets
        while stop < end:
            k = text[stop]
            if k in "”»」』›" and q > 0 or k == "“" and q > 0 and (stop + 1 >= end or not text[stop + 1].isalnum()):
                q -= 1
                closed_quote = True
            elif k == '"' and s:
                s = 0
                closed_quote = True
            elif k in ")）]】" and b > 0:
                b -= 1
            elif k in "   " and stop + 1 < end and text[stop + 1] in "»›" and q > 0:
                stop += 1
                continue
            else:
                break
            closed = True
            stop += 1
        if emoji := _EMOJI.match(text, stop, end):
            stop = emoji.end()
        if stop >= end:
            break
        skip = stop
        after = stop
        while after < end and text[after].isspace():
            after += 1
        if after >= end:
            break
        spaced = after > stop
        kind = _next_class(text, after, end)
        if kind == "joint":
            continue
        if mark[0] in "。！？।॥۔．｡။។":
            score = CLEAR
            if closed_quote and kind in ("caseless", "lower", "name"):
                score = UNLIKELY  # the sentence that carries the quotation goes on
        elif mark[0] == "…" or len(mark) > 1 and set(mark) == {"."}:
            score = CLEAR if spaced and kind in ("upper", "name", "end") else UNLIKELY
        elif mark[0] in "!?؟" or mark[-1] in "!?؟":
            if closed_quote and kind in ("caseless", "lower"):
                score = UNLIKELY
            elif spaced or emoji:
                score = CLEAR if kind != "lower" else DOUBTFUL
            else:
                nxt = text[after]
                score = CLEAR if nxt.isupper() or kind == "caseless" else NEVER
        elif closed:
            score = UNLIKELY if kind == "lower" or closed_quote and kind == "caseless" else CLEAR
            if not spaced and not text[after].isupper():
                score = NEVER
        elif emoji:
            score = CLEAR
        else:
            score = _full_stop(text, start, at, after, end, spaced, kind, learned)
        if score > NEVER:
            found.append((stop, score, (s, q, b)))
    if openers is not None and _SPACED.search(text, start, end):
        taken = {f[0] for f in found}
        pointer = 0
        for m in _SPACE.finditer(text, start, end):
            at = m.start()
            while pointer + 1 < len(states) and states[pointer + 1][0] <= at:
                pointer += 1
            if at in taken or at == start or m.end() >= end or text[at - 1] in ".,:;(":
                continue
            if not (_SPACED.match(text[at - 1]) or _SPACED.match(text[m.end()])):
                continue
            score = opening_score(openers, text[m.end():m.end() + PREFIXES[-1]])
            if text[at - 4:at] in ("ครับ", "นะคะ") or text[at - 3:at] == "ค่ะ":
                score += 1.0
            found.append((at, score, states[pointer][1]))
        found.sort()
    return found, (straight, quotes, brackets)


def opening(chunk: str) -> list[str]:
    """What stands for an opening word: letters of a script without spaces, the longest first, else a class."""
    c = chunk[:1]
    if _SPACED.match(c):
        word = _SPACE.split(chunk, 1)[0]
        return [word[:n] for n in reversed(PREFIXES) if n <= len(word)] or [word]
    return ["0" if c.isdigit() else "a" if c.isalpha() else "."]


def opening_score(openers: dict[str, float], chunk: str) -> float:
    """The score of the longest known beginning."""
    for key in opening(chunk):
        if key in openers:
            return openers[key]
    return UNLIKELY


def usual_length(text: str, start: int, end: int) -> float:
    if text.isascii():
        return USUAL["spaced"]
    probe = text[start:end]
    if _SPACED.search(probe):
        return USUAL["unspaced"]
    return USUAL["cjk"] if len(_CJK.findall(probe)) * 2 > len(probe) else USUAL["spaced"]


@lru_cache(maxsize=8)
def length_scores(usual: float) -> list[float]:
    """length_score of 0 to LONGEST characters."""
    out = [NEVER, NEVER]
    for n in range(2, LONGEST + 1):
        far = math.log(n / usual)
        out.append(max(-0.3, 0.3 - 0.15 * far * far))
    return out


def length_score(n: int, usual: float) -> float:
    """Up to 0.3 for a usual length and down to -0.3 for a very short or long one; none has less than two characters."""
    return length_scores(usual)[min(n, LONGEST)]


def spans(text: str, start: int, end: int, openers: dict[str, float] | None, learned: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """The chosen spans of a block, not yet trimmed."""
    found, last = candidates(text, start, end, openers, learned)
    found = [f for f in found if f[1] > UNLIKELY]
    if not found:
        return [(start, end)]
    usual = usual_length(text, start, end)
    ends = [(start, 0.0, (0, 0, 0)), *found, (end, 0.0, last)]
    best = [0.0]
    back = [0]
    far: dict[tuple[int, int, int], int] = {}  # the best beginning of each state at LONGEST or more before
    top = None  # and of all states
    reached = 0
    worth = length_scores(usual)
    beyond = worth[LONGEST]
    for j in range(1, len(ends)):
        stop, score, state = ends[j]
        while stop - ends[reached][0] >= LONGEST and reached < j:
            own = ends[reached][2]
            if own not in far or best[reached] > best[far[own]]:
                far[own] = reached
            if top is None or best[reached] > best[top]:
                top = reached
            reached += 1
        value, source = -math.inf, 0
        if top is not None:
            value, source = best[top] + beyond - (UNBALANCED if ends[top][2] != state else 0.0), top
            if state in far and best[far[state]] + beyond > value:
                value, source = best[far[state]] + beyond, far[state]
        for i in range(reached, j):
            own = best[i] + worth[stop - ends[i][0]] - (UNBALANCED if ends[i][2] != state else 0.0)
            if own > value:
                value, source = own, i
        best.append(value + score)
        back.append(source)
    chosen = []
    j = len(ends) - 1
    while j:
        chosen.append((ends[back[j]][0], ends[j][0]))
        j = back[j]
    return chosen[::-1]


def units(text: str | None, openers: dict[str, float] | None = None, learned: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text."""
    if not text or text.isspace():
        return []
    masked, found = blocks(text)
    out = []
    for start, end, heading in found:
        for a, b in ((start, end),) if heading else spans(masked, start, end, openers, learned):
            while a < b and masked[a].isspace():
                a += 1
            while b > a and masked[b - 1].isspace():
                b -= 1
            if heading:
                b = a + len(masked[a:b].rstrip("#").rstrip()) or b
            if b > a and _WORD.search(masked, a, b):
                out.append((a, b))
    return out


def fit_openers(documents: DataFrame) -> dict[str, float]:
    """Log-odds of beginnings to open a sentence, from all texts in scripts that divide sentences by spaces."""
    joined = F.regexp_replace("text", r"(?<!\n)\n(?!\s*(\n|[-*•#>=`]|\d+[.)]))", " ")
    line = F.explode(F.split(joined, r"\n")).alias("line")
    rows = documents.where(F.col("text").rlike(f"[{SPACED_SCRIPT}]")).select(line).where(F.col("line").rlike(f"[{SPACED_SCRIPT}]"))
    chunks = F.split(F.regexp_replace("line", r"^\s*([-*•]|\d+[.)]|#+)?\s+|^\s+", ""), r"\s+")
    parts = rows.select(F.posexplode(chunks).alias("n", "chunk")).where("chunk <> ''")
    letters = F.array_distinct(F.array(*[F.substring("chunk", 1, n) for n in PREFIXES]))
    keys = F.when(F.col("chunk").rlike(f"^[{SPACED_SCRIPT}]"), letters).otherwise(
        F.array(F.when(F.col("chunk").rlike(r"^\p{Nd}"), "0").when(F.col("chunk").rlike(r"^\p{L}"), "a").otherwise("."))
    )
    counts = parts.select("n", F.explode(keys).alias("key")).groupBy("key").agg(
        F.count_if(F.col("n") == 0).alias("first"), F.count_if(F.col("n") > 0).alias("inner")
    )
    counts = cut(counts)
    short = F.when(F.col("key").rlike(f"^[{SPACED_SCRIPT}]"), F.length("key") <= PREFIXES[0]).otherwise(True)
    total = counts.where(short).agg(F.sum("first").alias("first"), F.sum("inner").alias("inner")).first()
    firsts, inners = total["first"] or 1, total["inner"] or 1
    rows = counts.where((F.col("first") + F.col("inner")) > RAREST * (firsts + inners)).collect()  # 1 / RAREST a length
    base = firsts / (firsts + inners)
    share: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: len(r["key"])):
        key = r["key"]
        shorter = next((share[key[:n]] for n in reversed(PREFIXES) if n < len(key) and key[:n] in share), base)
        share[key] = (r["first"] + SMOOTHING * shorter) / (r["first"] + r["inner"] + SMOOTHING)
    logit = lambda p: math.log(p / (1 - p))
    safe = lambda p: min(max(p, 1e-9), 1 - 1e-9)
    return {k: max(-3.0, min(3.0, logit(safe(p)) - logit(safe(base)))) for k, p in share.items()}


def fit_abbreviations(documents: DataFrame) -> frozenset[str]:
    """Words of up to six letters that are abbreviations, by the counts over all texts.

    They have a full stop nearly always, and end paragraphs at most a tenth as often as full stops do in
    general, where chance would have them do so LEAST_STOPS times or more.
    """
    # Full stops within quotation marks end no paragraph. Pieces between blanks are counted as they are;
    # only the different ones are then looked into.
    pieces = F.filter(F.split("text", "[\"“”„«»「」『』]"), lambda x, i: i % 2 == 0)
    words = documents.where("text is not null").select(F.explode(F.split(F.concat(F.array_join(pieces, " "), F.lit("\n\n")), " ")).alias("w"))
    types = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("w").rlike(r"\p{L}"))
    own = F.explode(F.split(F.regexp_replace("w", r"\.[ \t]*\n\s*(\n|$)", ".¶\n"), r"[\s(\[{'‘]+")).alias("w")
    word = F.regexp_extract("w", r"^(\p{L}{1,6})(?:\.¶?|[,;:!?)\]}]*)$", 1)
    stop, final = F.col("w").contains("."), F.col("w").endswith("¶")
    counts = types.select(own, "n").groupBy(F.lower(word).alias("word")).agg(
        F.sum("n").alias("n"), F.sum(F.when(stop, F.col("n")).otherwise(0)).alias("stops"), F.sum(F.when(final, F.col("n")).otherwise(0)).alias("final")
    )
    counts = cut(counts.where("word <> '' and stops > 0"))
    total = counts.agg(F.sum("stops").alias("stops"), F.sum("final").alias("final")).first()
    stops, finals = total["stops"] or 0, total["final"] or 0
    if not finals:
        return frozenset()
    share = finals / stops
    kept = counts.where(
        (F.col("stops") >= 0.95 * F.col("n")) & (F.col("stops") * share >= LEAST_STOPS) & (F.col("final") <= 0.1 * share * F.col("stops")) & (F.col("stops") > RAREST * stops)
    )
    return frozenset(r["word"] for r in kept.select("word").collect())  # 1 / RAREST at most


def fit(documents: DataFrame) -> tuple[dict[str, float], frozenset[str]]:
    return fit_openers(documents), fit_abbreviations(documents)


def sentence_units(documents: DataFrame) -> DataFrame:
    """doc_id, start_char, end_char of the sentence units of every document (doc_id, text)."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, firsts, lasts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = units(text, *model.value)
                ids += [doc] * len(found)
                firsts += [a for a, _ in found]
                lasts += [b for _, b in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, type=pa.int64()) for x in (ids, firsts, lasts)], names=["doc_id", "start_char", "end_char"]
            )

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(split, "doc_id long, start_char long, end_char long")
