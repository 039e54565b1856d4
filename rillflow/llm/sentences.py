"""Sentence boundaries in any language and script, with their places.

A text is cut at its line breaks; within a line every mark that may end a sentence is a node of a terminator lattice, and what
stands on both sides (abbreviations, numbers, quotations and brackets, letter case) decides whether it does. Where a script has no
spaces, the words beside an uncertain gap come from the cheapest path through a lattice of dictionary words: those that the corpus
itself shows to be words (``boundary.learn``) and fixed function words. After dots, a final particle before the gap ends the sentence and
else a continuing word after it carries it on; after a quotation only the word that follows decides, as a quoted sentence has its own
particle. Where the corpus shows often enough how runs of characters stand to sure ends, that decides before the lists do. Abbreviations
are the fixed ones and those that the corpus shows. In Thai, a polite or asking particle ends a sentence even before a number. A line's
label, bullet or number never ends a sentence.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.boundary import NO_MODEL, Model, learn

# Abbreviations and words by what they do at a gap, in natural order.
#: Never end a sentence: titles, and words that point at what follows.
NEVER = frozenset(
    "dr mr mrs ms mx prof st sgt capt lt col gen maj rev hon sen rep gov messrs mme mlle mm hr fr herr dra sra srta sr dña lic ing mag dipl "
    "vs viz i.e e.g cf z.b d.h u.a bzw vgl evtl ggf inkl abb bd av avda blvd p.ex bspw sog ugs "
    "д-р проф им ул пл просп см напр т.е т.к гр акад κ κα δρ καθ βλ π.χ λ.χ डॉ प्रो श्री पं कु د أ ዶ/ር ดร ศ ผศ รศ นพ พญ".split()
)
#: Stand before a number or a name of a place in a text; end a sentence only before a capital.
POINTING = frozenset(
    "no nos nr núm num n fig figs sect sec vol vols ver ch chap p pp pg pág págs art seg eq eqs abschn tel min max approx aprox env ca circa ed eds tab kap "
    "рис стр ок гл табл αρ εικ σελ περ кл नं पृ मी ص م ث ቁ ሜ".split()
)
#: May end a sentence before a capital although they are abbreviations.
CLOSING = frozenset("a.m p.m etc usw ff jr inc ltd co corp т.д т.п и.т.д κ.λπ κλπ ktl".split())
#: Words before a German ordinal number.
ORDINAL_LEADS = frozenset("im am dem den der des vom zum seit bis ab ins und".split())
#: Openers of an aside that a sentence may begin with.
_OPENING = "([{（【〔«“„「『‘¿¡\"'《〈‹”"
_CLOSERS = "\"'”’»›“‘」』）)]}】〕》〉"
#: Words of scripts without spaces that continue a sentence after a quotation or dots, that open one, and that close one.
CONTINUING = frozenset(
    "的 地 得 等 这 那 之 与 和 或 是 为 作 字样 字 几个 这样 这个 一词 一句 三个字 两个字 四个字 "
    "と という といった って との とは も の を に が は で へ や から まで など と書かれた と言い と言って と叫び と呼ばれる".split()
)
OPENERS = frozenset(
    "与此同时 的确 的士 这时 那么 这里 那里 这些 那些 和平 为了 为什么 是否 等到 随后 然后 接着 最后 画面中 大约 但是 不过 因此 所以 "
    "地球 地上 地面 地铁 地图 地板 地方 地下 地点 地震 地区 得到 得知 得分 得意 等待 等候 等级 这是 这种 这位 这次 这天 这边 这部 这座 这名 这张 这场 这么 这群 "
    "那是 那种 那位 那次 那天 那边 那时 那年 那名 那座 那只 这只 与其 与会者 和谐 和尚 和气 或许 是的 是啊 为何 为此 作者 作业 作品 作家 字母 字幕 字典 "
    "とても とりあえず ところが ときどき とうとう もう もし もっと もちろん のち がんばれ はい はじめに ではなく でも できれば やがて やはり からだ へえ "
    "とにかく とりわけ ところで ともかく ともだち とっさに とうぜん とくに とつぜん とんでもない とはいえ もっとも もうすぐ もしも もしかすると もしかして ものすごく もともと "
    "のんびり のろのろ のちほど にわとり にわか にこにこ にっこり にぎやか にんじん がっかり がやがや がんばって がんばろう はやく はやい はじめて はるか はっきり はたして "
    "できるだけ できる できた でんしゃ でぐち でこぼこ へとへと やっと やっぱり やさしい やすい やすみ からす からっぽ".split()
)
FINAL = frozenset(
    "了 吗 呢 吧 啊 呀 嘛 啦 です ます でした ました ません でしょう ましょう ください なさい だろう だ よ ね か る た い す わ ぞ ครับ ค่ะ คะ นะ ไหม หรือไม่".split()
)
#: Words that end in a final particle without being one.
_OTHER = frozenset("ชนะ สถานะ ภาชนะ".split())
_WORDS = CONTINUING | OPENERS | FINAL | _OTHER
#: Cost, in nats, of a function word and of a letter that belongs to no word.
_FUNCTION, _UNKNOWN = 3.0, 14.0

_BREAK = re.compile("\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]")
_LABEL = re.compile(
    r"[\s\ufeff\u200b]*(?:(?:\[[^\]]{0,120}\]|[-*•·–—▪◦‣●○■□►]+(?=\s)|\(?\d{1,3}[.)、．）](?!\d)|\(?[^\W\d_][.)](?=\s)|#{1,6}(?=\s)|>+(?=\s)|[①-⑳])[\s\ufeff]*)*"
)
#: Thai and Lao, whose sentences end at spaces.
_THAI = "ก-ฺเ-๎\u0e81-\u0ebd\u0ec0-\u0ece\u0edc-\u0edf"
#: Other scripts without spaces between words: Tibetan, Burmese, Khmer, Tai, Balinese, Javanese.
_SOUTHEAST = re.compile("[\u0e81-\u0ebd\u0ec0-\u0ece\u0edc-\u0edf\u0f00-\u0f0c\u0f40-\u0fbc\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u17d7\u17dc-\u17e9\u1950-\u19df\u1a20-\u1a99\u1b00-\u1b4c\ua980-\ua9c0\ua9cf-\ua9fe\uaa60-\uaadf]")
#: Unicode's Sentence_Terminal without ASCII, and without U+104A, which is a comma in Burmese.
_TERMINAL = (
    "\u0589\u061d-\u061f\u06d4\u0700-\u0702\u07f9\u0837\u0839\u083d\u083e\u0964\u0965\u104b\u1362\u1367\u1368\u166e\u1735\u1736"
    "\u17d4\u17d5\u1803\u1809\u1944\u1945\u1aa8-\u1aab\u1b4e\u1b4f\u1b5a\u1b5b\u1b5e\u1b5f\u1b7d-\u1b7f\u1c3b\u1c3c\u1c7e\u1c7f\u2024"
    "\u203c\u203d\u2047-\u2049\u2cf9-\u2cfb\u2e2e\u2e3c\u2e53\u2e54\u2e60\u2e61\u3002\ua4ff\ua60e\ua60f\ua6f3\ua6f7\ua876\ua877"
    "\ua8ce\ua8cf\ua92f\ua9c8\ua9c9\uaa5d-\uaa5f\uaaf0\uaaf1\uabeb\ufe12\ufe15\ufe16\ufe52\ufe56\ufe57\uff01\uff0e\uff1f\uff61"
    "\U00010a56\U00010a57\U00010f55-\U00010f59\U00010f86-\U00010f89\U00011047\U00011048\U000110be-\U000110c1\U00011141-\U00011143"
    "\U000111c5\U000111c6\U000111cd\U000111de\U000111df\U00011238\U00011239\U0001123b\U0001123c\U000112a9\U000113d4\U000113d5"
    "\U0001144b\U0001144c\U000115c2\U000115c3\U000115c9-\U000115d7\U00011641\U00011642\U0001173c-\U0001173e\U00011944\U00011946"
    "\U00011a42\U00011a43\U00011a9b\U00011a9c\U00011c41\U00011c42\U00011ef7\U00011ef8\U00011f43\U00011f44\U00016a6e\U00016a6f\U00016af5"
    "\U00016b37\U00016b38\U00016b44\U00016d6e\U00016d6f\U00016e98\U0001bc9f\U0001da88"
)
_GREEK = "Ͱ-Ͽἀ-῿"
_MARKS = re.compile(rf"[\u0f0d\u0f0e](?: ?[\u0f0d\u0f0e])*|(?:[.!?…\u037e{_TERMINAL}]|(?<=[{_GREEK}]);)+")
#: The same where a line holds none of the characters of ``_RARE``, which need a look around; signs of a line to look at for more.
_COMMON = re.compile(f"[.!?…\u037e{_TERMINAL}]+")
#: The same without characters beyond the first plane, which the engine looks up faster, for texts that have none.
_PLAIN, _BEYOND = re.compile("[.!?…\u037e" + re.match("[\x00-\uffff]*", _TERMINAL).group() + "]+"), re.compile("[\U00010000-\U0010ffff]")
_RARE = ";\u0f0d\u0f0e"
_HAS_THAI, _SAID = re.compile(f"[{_THAI}]"), re.compile(r"[^\W_]")
_THAI_GAP = re.compile(rf"(?<=[{_THAI}])[ \t\xa0\u200b\u3000]+(?=\S)")
_PAIRS = {"“": "”", "„": "“”", "”": "“", "«": "»", "»": "«", "‹": "›", '"': '"', "'": "'", "‘": "’", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "（": "）", "[": "]", "【": "】", "{": "}"}
_PAIRED = re.compile(r"[“„”«»‹›\"'‘’「」『』《》〈〉()（）\[\]【】{}]")
_ROUND = "(（[【{"
_ALWAYS_OPEN, _ALWAYS_CLOSE = "„«‹「『《〈(（[【{", "»›」』》〉)）]】}"
_SPEECH = ":：,，،、፦"
_NUMBER = re.compile(r"[-+]?\d[\d.,٫]*|[٠-٩۰-۹०-९][٠-٩۰-۹०-९.,٫]*")


class Lexicon:
    """The words of a lattice with their costs. A word of the corpus that begins with a continuing word is one only if it opens sentences."""

    def __init__(self, model: Model = NO_MODEL):
        self.model = model
        self.cost = {w: c for w, c in model.words.items() if model.opens.get(w) or not any(w[:k] in CONTINUING for k in range(1, len(w)))}
        self.cost |= dict.fromkeys(_WORDS, _FUNCTION)
        self.longest = max(map(len, self.cost))

    def path(self, text: str) -> list[str]:
        """The words on the cheapest path through the lattice of ``text``; the fewest words of equal costs."""
        size, cost = len(text), self.cost
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(math.inf, 0, 0)] * size  # cost, words, length of the last word
        for i in range(size):
            now, words, _ = best[i]
            for n in range(1, min(self.longest, size - i) + 1):
                price = cost.get(text[i : i + n], _UNKNOWN if n == 1 else None)
                if price is not None and (now + price, words + 1) < best[i + n][:2]:
                    best[i + n] = (now + price, words + 1, n)
        out = []
        while size:
            out.append(text[size - best[size][2] : size])
            size -= best[size][2]
        return out[::-1]

    def first_word(self, text: str, at: int, end: int) -> str:
        """The first word at ``at``."""
        return (self.path(text[at : min(end, at + 2 * self.longest)]) or [""])[0]

    def last_word(self, text: str, start: int, at: int) -> str:
        """The last word before ``at`` of a text that begins at ``start``."""
        return (self.path(text[max(start, at - 2 * self.longest) : at]) or [""])[-1]

    def continues(self, text: str, at: int, end: int) -> bool:
        """Whether what stands at ``at`` carries a sentence on."""
        known = self.model.opening(text, at, end)
        return self.first_word(text, at, end) in CONTINUING if known is None else not known

    def closes(self, text: str, start: int, at: int) -> bool:
        """Whether what stands before ``at`` is final."""
        known = self.model.closes(text, start, at)
        return self.last_word(text, start, at) in FINAL if known is None else known


PLAIN = Lexicon()


def _spaceless(c: str) -> bool:
    return c >= "\u0e81" and ("぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or "\U00020000" <= c <= "\U0003ffff" or "가" <= c <= "힣" or bool(_SOUTHEAST.match(c)))


def _asides(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets of a line that close in it, as (opening, closing) places."""
    open_: list[tuple[int, str]] = []
    found: list[tuple[int, int]] = []
    for m in _PAIRED.finditer(text, start, end):
        i, c = m.start(), m.group()
        before, after = text[i - 1] if i > start else " ", text[i + 1] if i + 1 < end else " "
        may_open = (before.isspace() or before in _OPENING + "-–—/:：") and not after.isspace()
        may_close = not before.isspace() and not (after.isalnum() and before.isalnum())
        if c in "'’" and before.isalnum() and after.isalnum():
            continue
        if c in _ALWAYS_OPEN:
            closes = False
        elif c in _ALWAYS_CLOSE:
            closes = True
        elif c in "\"'":
            closes = not may_open and may_close
            if not closes and not may_open:
                continue
        elif may_open != (may_close and (after.isspace() or not after.isalnum())):
            closes = not may_open
        else:
            closes = c in "”’"
        if closes:
            for k in range(len(open_) - 1, -1, -1):
                if c in _PAIRS[open_[k][1]]:
                    found.append((open_[k][0], i))
                    del open_[k:]
                    break
        elif c in _PAIRS:
            open_.append((i, c))
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


def _token(text: str, at: int, low: int) -> tuple[str, int]:
    """The word that ends at ``at`` without opening marks, and where it starts with them."""
    near = text[max(low, at - 48) : at]
    if near.isascii() and near[-1:].strip() and len(said := near.split()[-1]) < 48:
        return said.lstrip(_OPENING + "-–—").casefold(), at - len(said)
    i = at
    spaceless = at > low and _spaceless(text[at - 1])
    while i > low and not text[i - 1].isspace() and text[i - 1] not in "。！？｡．…，、：；」』）》〉" and _spaceless(text[i - 1]) == spaceless:
        i -= 1
    return text[i:at].lstrip(_OPENING + "-–—").casefold(), i


def _mixed_case(text: str, at: int, end: int) -> bool:
    """A word such as iCam, which may open a sentence although it is in lower case."""
    return at + 1 < end and text[at].islower() and text[at + 1].isupper()


class _Line:
    def __init__(self, text: str, start: int, end: int, lexicon: Lexicon, marks: re.Pattern = _COMMON):
        self.text, self.end, self.lexicon, self.marks = text, end, lexicon, marks
        self.begin = min(_LABEL.match(text, start, end).end(), end)
        self.asides = _asides(text, self.begin, end)
        self.opens = [a for a, _ in self.asides]

    def aside(self, at: int) -> tuple[int, int] | None:
        k = bisect_right(self.opens, at) - 1
        return self.asides[k] if k >= 0 and self.asides[k][0] < at < self.asides[k][1] else None

    def ends(self) -> Iterator[int]:
        """Ends of the line's sentences but the last, which is the line's."""
        text, end, sentence = self.text, self.end, self.begin
        marks = _MARKS if any(text.find(c, self.begin, end) >= 0 for c in _RARE) else self.marks
        gaps = [(m.start(), m.end(), True) for m in marks.finditer(text, self.begin, end)]
        if _HAS_THAI.search(text, self.begin, end):
            gaps = sorted(gaps + [(m.start(), m.end(), False) for m in _THAI_GAP.finditer(text, self.begin, end)])
        done = -1
        for a, b, mark in gaps:
            if a < done:
                continue
            stop = self._mark(a, b, sentence) if mark else self._thai(a, b, sentence)
            if stop and stop > sentence and _SAID.search(text, sentence, stop):
                yield stop
                done = sentence = stop
                while sentence < end and text[sentence].isspace():
                    sentence += 1

    def _thai(self, a: int, b: int, sentence: int) -> int | None:
        text, after = self.text, self.text[b]
        if self.aside(a) or after in _CLOSERS + _OPENING and after not in "([（¿¡":
            return None
        if self.lexicon.last_word(text, sentence, a) in FINAL:
            return a
        if number := _NUMBER.match(text, b, self.end):
            i = number.end()
            while i < self.end and text[i].isspace():
                i += 1
            return a if i > number.end() and i < self.end and text[i].isalpha() and text[i].isascii() else None
        return a

    def _mark(self, a: int, b: int, sentence: int) -> int | None:
        text, end = self.text, self.end
        marks, inside = text[a:b], self.aside(a)
        stop = b
        while stop < end:  # closing marks belong to the sentence; French ones stand behind a space
            c = text[stop]
            if c in _CLOSERS and (inside is None and c not in "\"'“‘”" or inside is not None and stop <= inside[1] or c in ")）]】」』"):
                stop += 1
            elif c in " \xa0\u202f" and stop + 1 < end and text[stop + 1] in "»›" and inside and stop + 1 <= inside[1]:
                stop += 2
            else:
                break
        if inside and stop <= inside[1]:
            return None  # further text of the same aside follows
        n = stop
        while n < end and text[n].isspace():
            n += 1
        if n >= end:
            return None  # the line's end
        nxt, spaced = text[n], n > stop
        if nxt in ",，、;；،:：" or nxt in ")）]】":
            return None
        if inside:
            return stop if self._after_aside(inside, n, spaced, sentence) else None
        head = n
        while head < end and text[head] in _OPENING + "-–— ":
            head += 1
        first = text[head] if head < end else nxt
        lower = first.islower() and not _mixed_case(text, head, end)
        if marks == ".":
            return stop if self._dot(a, n, spaced, first, lower, stop > b, sentence) else None
        if marks in ("．", "․", "﹒"):
            return None if a and text[a - 1].isdigit() and nxt.isdigit() and not spaced else stop
        if "…" in marks or ".." in marks:
            if lower:
                return None
            if first.isdigit() and not re.search(r"\s", text[sentence:a].strip()):
                return None  # one word and dots before a number: a pause
            if _spaceless(first) and not spaced and a and _spaceless(text[a - 1]):
                return None if self.lexicon.continues(text, n, end) and not self.lexicon.closes(text, sentence, a) else stop
            return stop if spaced or not first.isascii() or first.isupper() else None
        if lower:
            return None
        if not spaced and marks.isascii() and first.isascii() and not (first.isupper() or nxt in _OPENING):
            return None
        return stop

    def _after_aside(self, inside: tuple[int, int], n: int, spaced: bool, sentence: int) -> bool:
        """Whether a quotation or bracket that ends with a mark ends the sentence around it."""
        text = self.text
        k = inside[0] - 1
        while k >= sentence and text[k].isspace():
            k -= 1
        opened = k < sentence
        if text[inside[0]] in _ROUND:
            return opened
        head = n
        while head < self.end and text[head] in _OPENING + "-–— ":
            head += 1
        first = text[head] if head < self.end else text[n]
        if first.islower() and not _mixed_case(text, head, self.end):
            return False
        if _spaceless(first) and not spaced:
            return not self.lexicon.continues(text, n, self.end) and (opened or text[k] in _SPEECH) and not "가" <= first <= "힣"
        if opened or text[k] in _SPEECH:
            return True
        return first.isupper() or _mixed_case(text, head, self.end)

    def _dot(self, a: int, n: int, spaced: bool, first: str, lower: bool, closed: bool, sentence: int) -> bool:
        text = self.text
        before = text[a - 1] if a > self.begin else " "
        if before.isspace():
            return spaced and not lower
        if before in _CLOSERS or closed:
            return spaced and not lower or (not spaced and (first.isupper() or _spaceless(first)))
        word, at = _token(text, a, sentence)
        if "'" in word or "’" in word:  # d'env.
            word = re.split("['’]", word)[-1] or word
        if not spaced:
            if first.isdigit() or not first.isalpha():
                return False
            if not first.isascii() and not first.isupper() and not first.islower():
                return before.isalnum() and word not in NEVER and word not in POINTING and "." not in word and (len(word) > 1 or before.isdigit())
            if not first.isupper() or word in NEVER:
                return False
            if word in CLOSING:
                return True
            if len(word) == 1 and word.isalpha():
                return text[sentence:at].rstrip()[-1:] in ("+", "=")
            follows = text[n + 1] if n + 1 < self.end else " "
            part = word.rpartition("-")[2]
            long = len(part) > 1 and part.isalpha() and before.islower() or before.isdigit() and word[:1].isdigit()
            return long and (follows.islower() or follows in ". '’" or follows.isspace() or bool(re.match(r"[^\W\d_]{2,} \w", text[n : n + 24])))
        i = at
        while i > sentence and text[i - 1].isspace():
            i -= 1
        previous, _ = _token(text, i, sentence)
        pair = f"{previous}{word}" if previous.endswith(".") and len(previous) <= 3 and len(word) <= 2 else ""
        if word in CLOSING or pair in CLOSING:
            return not lower
        if word in NEVER or pair in NEVER or lower:
            return False
        if word in self.lexicon.model.never and word not in POINTING:
            return False
        if word in POINTING:
            return first.isupper() and (len(word) > 1 or bool(_NUMBER.fullmatch(previous)))
        if len(word) == 1 and word.isalpha():
            if _NUMBER.fullmatch(previous):
                return True  # a unit
            return previous in ("+", "=", "-", "*", "/")
        if word.isdigit() and len(word) <= 2 and first.isupper() and previous in ORDINAL_LEADS:
            return False
        return True


def sentence_ends(text: str | None, lexicon: Lexicon = PLAIN) -> list[int]:
    """Code points from the text's start through each sentence's last character; none for null and blank texts."""
    out: list[int] = []
    if not text:
        return out
    at, carried = 0, False
    marks = _COMMON if _BEYOND.search(text) else _PLAIN
    breaks = [(m.start(), m.end()) for m in _BREAK.finditer(text)] + [(len(text), len(text))]
    for stop, after in breaks:
        end = stop
        while end > at and (text[end - 1].isspace() or text[end - 1] in "\ufeff\u200b"):
            end -= 1
        if end > at and _SAID.search(text, at, end):
            line = _Line(text, at, end, lexicon, marks)
            out.extend(line.ends())
            if line.begin < end:  # a label alone belongs to the line that follows
                out.append(end)
                carried = False
            else:
                carried = True
        at = after
    if carried:
        end = len(text.rstrip("\ufeff\u200b \t\r\n\v\f\x85\u2028\u2029\xa0"))
        if end and (not out or end > out[-1]):
            out.append(end)
    return out


def sentences(df: DataFrame, ident: str, text: str, model: Model | None = None) -> DataFrame:
    """``ident, sentence_no, start_char, end_char, sentence`` for every sentence of every text of ``df``.

    ``end_char`` counts the code points from the text's start through the sentence's last character, ``start_char`` those before its
    first; blanks between sentences belong to none. Null, empty and blank texts have no rows; a text of punctuation alone has none;
    repeated rows give their sentences each. Texts of any length are read whole, in the task that holds them.

    ``model`` is what ``boundary.learn`` found; if None it is learned from all texts of ``df`` first, which reads them once more and
    shuffles counters only. ``NO_MODEL`` uses the fixed words alone.
    """
    shared = df.sparkSession.sparkContext.broadcast(learn(df, text) if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            rows: list[tuple[int, int, int, int, str]] = []
            for r, t in enumerate(batch["_text"].to_pylist()):
                begin = 0
                for k, stop in enumerate(sentence_ends(t, lexicon)):
                    while begin < stop and (t[begin].isspace() or t[begin] in "\ufeff\u200b"):
                        begin += 1
                    rows.append((r, k, begin, stop, t[begin:stop]))
                    begin = stop
            source, number, starts, ends, parts = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.record_batch({
                ident: batch[ident].take(pa.array(source, pa.int64())), "sentence_no": pa.array(number, pa.int64()), "start_char": pa.array(starts, pa.int64()),
                "end_char": pa.array(ends, pa.int64()), "sentence": pa.array(parts, pa.string()),
            })

    kind = dict(df.dtypes)[ident]
    return df.select(ident, F.col(text).alias("_text")).mapInArrow(run, f"`{ident}` {kind}, sentence_no long, start_char long, end_char long, sentence string")
