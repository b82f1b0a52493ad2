"""Problem 4: noise of scanned pages - furniture removed, split words joined, misread characters edited.

Averaged perceptrons decide. The character editor predicts, at each place where the table of similar shapes or a hyphen at
a line's end proposes something, whether to keep it, replace a character, replace it by two (insert), replace two by one
(delete), or join two lines; it is trained on a bounded sample of the corpus's own text, with characters exchanged and
words split. Its features compare how common the word (or the characters around) is in the whole corpus before and after
the edit, so that they do not depend on a vocabulary. A second one predicts which lines are furniture, from the form of a
line, its place on the page and the lines around it.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from chatloom.runtime import bounded_sample

from .counts import WORDS, Counts, leveled, of_corpus, of_texts

# What is read, then what may have stood there.
LATIN = [("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("@", "a"), ("5", "s"), ("$", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"), ("4", "a"), ("7", "t"), ("c", "e"), ("e", "c"), ("cl", "d"), ("d", "cl"), ("b", "h"), ("h", "b"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("nn", "m"), ("u", "v"), ("v", "u"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("q", "g"), ("g", "q")]
HAN = "侯候 坏还 丅下 夭天 设没 着看 牛午 处外 令今 咋昨 活话 睌晚 己已 已己 未末 末未 人入 入人 土士 士土 日曰 曰日 大太 太大 犬大 木本 本木 看着 候侯 还坏 没设 午牛 外处 今令 昨咋 话活 天夭 干千 千干 于干 子孑 乌鸟 鸟乌 贝见 见贝 目且 且目 白自 自白 田由 由田 甲申 申甲 王玉 玉王 刀力 力刀 九丸 几凡 凡几 冉再 再冉 准淮 淮准 住往 往住 佳住 待侍 侍待 请清 清请 情清 晴睛 睛晴 拆折 折拆 折析 拔拨 拨拔 拾捨 抬拾 拾抬 搬般 船般 衣农 农衣 免兔 兔免 雨两 两雨 问间 间问 间闻 闻间 问同 同问 门问 开井 井开 夫天 天夫 失矢 戊戌 戌戊 戍戊 治冶 冶治 汁汗 汗汁 沽活 泊伯 找我 我找 代伐 伐代 茶荼 荼茶 崇祟 密蜜 晒洒 洒晒 酒洒 洒酒 旱早 早旱 旧归 归旧 旦旧 了子 子了 丁了 卜下 上土 下卞 气乞 历厉 厂广 广厂 厅斤 斥斤 斤斥 尺尽 史吏 吏史 夹央 央夹 边力 辽迂 过这 这过 远运 运远 迟退 刚则 则刚 到倒 倒到 刮舌 挂桂 桂挂 柱桂 桩柱 柜桓 框柜 架柴 栏拦 拦栏 栅珊 梯悌 椅倚 凳登 灯灮 灯打 炉护 烂拦 锁销 销锁 锤锺 镜境 境镜 钩钓 钓钩 铃钤 铜桐 银根 根银 垫势 毯毡 帘帝 帐怅 帚帝 扇扁 伞余 余伞 壶壸 瓶瓴 杯坏 怀坏 坏怀 盆盒 盒盆 篮蓝 蓝篮 筝争 纸低 低纸 绒线 线绒 结给 给结 终络 络终".split()
HAN_OF: dict[str, list[str]] = {}
for _p in HAN:
    HAN_OF.setdefault(_p[0], []).append(_p[1])
TOKEN = WORDS
HYPHEN = re.compile(r"([^\W\d_]+)[-‐‑­][ \t]*\n[ \t]*([^\W\d_]+)")
NUMBER = re.compile(r"(?i)^\s*(?:[-–—\[(（·.•*]*\s*\d{1,4}\s*[-–—\])）·.•*]*|\d{1,4}\s*[/／]\s*\d{1,4}|第\s*\d{1,4}\s*页(?:\s*[,，/]?\s*共\s*\d{1,4}\s*页)?|(?:page|pg\.?|p\.|seite|s\.)\s*\d{1,4}(?:\s*(?:of|/|von)\s*\d{1,4})?)\s*$")
NUMBERED = re.compile(r"^\s*(?:(?P<a>\d{1,4})(?:\s+[|·-]?\s*|\s*[|·]\s*)(?P<t>\D.*?)|(?P<u>\D.*?)(?:\s+[|·-]?\s*|\s*[|·]\s*)(?P<b>\d{1,4}))\s*$")
FRAME = re.compile(r"^\s*[—–\-=~*·|【《]+\s*(\S.*?\S)\s*[—–\-=~*·|】》]+\s*$")
ZH_TITLE = re.compile(r"^[一-鿿A-Za-z0-9 ]{2,20}(?:手册|指南|公约|章程|须知|细则|守则|年鉴|通讯|简报|规定|制度|条例|办法|名录|目录|说明|纪要|汇编|公报|月报|周报|年报|通知|规程|规范|方案|报告)(?:[·・:： ]?(?:[上中下]册|附录|第.{1,3}[册卷版章]|[一-鿿]{2}))?(?:\s*[（(][^）)]{1,6}[）)])?$")
STOP = re.compile(r"[。！？!?；;，,…]|[.:：](?:\s|$)")
_HAN_OLD = re.compile(f"[{''.join(HAN_OF)}]")
KINDS = ("hyphen", "misread", "header", "page_number")
_ADDRESS = re.compile(r"[@.][\w]|[+\-_]\w*@|\w*\.\w*/")
MODEL_TEXTS, ROUNDS = 12000, 3
#: A word found more often (for its size, in a large corpus) is none that was misread; most entries of each memo of a worker.
COMMON, MEMO = 50, 200_000


def _title(line: str, least: int = 3) -> bool:
    """Whether a line is a title by its form alone; one of other alphabets than Han has ``least`` words."""
    line = m.group(1) if (m := FRAME.match(line)) else line.strip()
    if not line or len(line) > 60 or STOP.search(line):
        return False
    if ZH_TITLE.match(line):
        return True
    words = re.findall(r"[^\W\d_]+", line)
    return len(words) >= least and not re.search("[一-鿿]", line) and all(w[0].isupper() or w in ("of", "the", "and", "for", "in", "der", "die", "und") for w in words) and not line.isupper()


def _joins_on(lines: list[str]) -> bool:
    """Whether the lines are a page's: text of several lines of about one width, broken within sentences."""
    long = [x for x in lines if len(x.strip()) >= 8 and not NUMBER.match(x)]
    if len(long) < 4:
        return False
    width = sorted(map(len, long))[len(long) // 2]
    whole = [x for x in long if abs(len(x) - width) <= max(8, width // 4)]
    broken = sum(not re.search(r"[。！？!?.…~”\"]\s*$", x) for x in whole)
    return len(whole) * 2 >= len(long) and broken * 4 >= len(whole)


def _form(line: str) -> frozenset[str]:
    """What a line could be by its form: kinds of furniture, none for text."""
    if NUMBER.match(line):
        return frozenset({"page_number"})
    if (m := NUMBERED.match(line)) and _title(m.group("t") or m.group("u"), 2):
        return frozenset({"page_number", "header"})
    if _title(line, 2 if FRAME.match(line) else 3) or (f := FRAME.match(line)) and len(f.group(1)) <= 40 and not STOP.search(f.group(1)):
        return frozenset({"header"})
    return frozenset()


def line_features(lines: list[str], at: int, form: frozenset[str], page: bool) -> list[str]:
    """Form of a line, its place from the top and the bottom, and whether the text runs on around it."""
    n = len(lines)
    before = next((x for x in reversed(lines[:at]) if x.strip()), "")
    after = next((x for x in lines[at + 1 :] if x.strip()), "")
    ends = bool(re.search(r"[。！？!?.…]\s*$", before)) if before else None
    begins = after.strip()[:1].islower() if after.strip() else None
    kind = "+".join(sorted(form))
    place = "first" if at == 0 else "last" if at == n - 1 else "inside"
    return [f"k{kind}", f"p{page}", f"k{kind}p{page}", f"k{kind}{place}", f"t{min(at, 3)}", f"b{min(n - 1 - at, 3)}", f"h{10 * at // n}", f"e{ends}{begins}", f"n{min(n, 8)}", f"f{bool(FRAME.match(lines[at]))}"]


class Perceptron:
    """Averaged perceptron over sets of features; a positive score is a yes."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features])

    @classmethod
    def train(cls, examples: list[tuple[list[str], bool]], rng: random.Random, rounds: int = ROUNDS) -> Perceptron:
        weights, totals, stamps, step = {}, Counter(), Counter(), 0
        for _ in range(rounds):
            rng.shuffle(examples)
            for f, good in examples:
                step += 1
                if (sum(weights.get(x, 0.0) for x in f) > 0) != good:
                    for x in f:
                        w = weights.get(x, 0.0)
                        totals[x] += (step - stamps[x]) * w
                        stamps[x] = step
                        weights[x] = w + (1.0 if good else -1.0)
        return cls({x: (totals[x] + (step - stamps[x]) * w) / max(step, 1) for x, w in weights.items()})


def _step(n: int) -> int:
    return min(n.bit_length(), 9)


class Editor:
    """The two perceptrons, with the counts that the editor looks up."""

    def __init__(self, counts: Counts, edits: dict[str, float] | None = None, lines: dict[str, float] | None = None):
        self.counts, self.model, self.line_model = counts, Perceptron(edits), Perceptron(lines)
        self._common: set[str] = set()
        self._words: dict[str, list] = {}
        self._around: dict[tuple[str, str], list] = {}

    def furniture(self, text: str) -> tuple[list[str], set[str], bool]:
        """The lines without running headers and page numbers, the kinds left out, and whether the text is a page."""
        lines = text.split("\n")
        if len(lines) < 4:
            return lines, set(), False
        page = _joins_on(lines)
        kept, kinds = [], set()
        for at, line in enumerate(lines):
            form = _form(line)
            if form and self.line_model.score(line_features(lines, at, form, page)) > 0:
                kinds |= form
            else:
                kept.append(line)
        return kept, kinds, page

    def joins(self, a: str, b: str) -> bool:
        """Whether a hyphen at a line's end splits a word."""
        return self.model.score(join_features(a, b, self.counts.word, self.counts.word_scale)) > 0

    def _of_word(self, low: str):
        """``start, end, new, features`` of the edits proposed in a word; none in a common one."""
        word, scale = self.counts.word, self.counts.word_scale
        found = word(low)
        if found > COMMON * scale:
            return
        for old, new in LATIN:
            at = low.find(old)
            while at >= 0:
                before, after = leveled(scale, found, word(low[:at] + new + low[at + len(old) :]))
                if after > 2:
                    yield at, at + len(old), new, word_features(before, after, old, new, at == 0 or at + len(old) == len(low))
                at = low.find(old, at + 1)

    def _of_han(self, left: str, c: str, right: str):
        """``new, features`` of what may have stood for a Han character between up to two others on each side."""
        run, scale = self.counts.run, self.counts.run_scale
        if len(left + right) < 2:
            return
        for new in HAN_OF[c]:
            f = ["h", "o:replace", f"e{c}>{new}"]
            gain, most_x, most_y, middle = 0.0, 0, 0, False
            for a, b in ((left, ""), (left[-1:], right[:1]), ("", right)):
                x, y = leveled(scale, run(a + c + b), run(a + new + b))
                f.append(f"r{len(a)}{_step(x)}>{_step(y)}")
                gain += log2(1 + y) - log2(1 + x)
                most_x, most_y = max(most_x, x), max(most_y, y)
                middle = middle or bool(a and b and y > x)
            f.append(f"g{max(-6, min(12, int(gain)))}")
            # both characters may be common: the new one must fit between its neighbours, and better than the old one
            if gain > 0 and middle and most_y > most_x:
                yield new, f

    def edits(self, text: str):
        """``start, end, new, features`` of every edit the table proposes."""
        for m in TOKEN.finditer(text):
            w = m.group()
            if len(w) > 2 and w.isascii() and not _in_address(text, m.start(), m.end()):
                for a, b, new, f in self._of_word(w.lower()):
                    yield m.start() + a, m.start() + b, new, f
        for m in _HAN_OLD.finditer(text):
            i = m.start()
            for new, f in self._of_han(text[max(0, i - 2) : i], m.group(), text[i + 1 : i + 3]):
                yield i, i + 1, new, f

    def accepted(self, text: str) -> list[tuple[float, int, int, str]]:
        """``score, start, end, new`` of the edits with a positive score. Words and surroundings met before are not judged
        again, and common words not looked at."""
        out, score = [], self.model.score
        rare = set()
        for w in set(TOKEN.findall(text)) - self._common:
            low = w.lower()
            if len(w) < 3 or not w.isascii() or self.counts.word(low) > COMMON * self.counts.word_scale:
                self._common.add(w)
                continue
            if low not in self._words:
                self._words[low] = [(s, a, b, new) for a, b, new, f in self._of_word(low) if (s := score(f)) > 0]
            if self._words[low]:
                rare.add(w)
        if rare:
            for m in TOKEN.finditer(text):
                if m.group() in rare and not _in_address(text, m.start(), m.end()):
                    out += [(s, m.start() + a, m.start() + b, new) for s, a, b, new in self._words[m.group().lower()]]
        for m in _HAN_OLD.finditer(text):
            i = m.start()
            around = (text[max(0, i - 2) : i], text[i : i + 3])
            found = self._around.get(around)
            if found is None:
                found = self._around[around] = [(s, new) for new, f in self._of_han(around[0], m.group(), around[1][1:]) if (s := score(f)) > 0]
            out += [(s, i, i + 1, new) for s, new in found]
        for memo in (self._common, self._words, self._around):
            if len(memo) > MEMO:
                memo.clear()
        return out

    def correct(self, text: str) -> tuple[str, int]:
        """The text with the accepted edits, and their number; of edits that touch, the better one."""
        taken: list[tuple[int, int, str]] = []
        for _, a, b, n in sorted(self.accepted(text), key=lambda x: (-x[0], x[1])):
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, n))
        for a, b, n in sorted(taken, reverse=True):
            text = text[:a] + (n.upper() if text[a:b].isupper() else n) + text[b:]
        return text, len(taken)


def _in_address(text: str, start: int, end: int) -> bool:
    """Whether a word is part of a link, a mail address, a file or a number with signs."""
    if start and text[start - 1] in "@./_+-=" or "://" in text[max(0, start - 30) : start + 1].rsplit(" ", 1)[-1]:
        return True
    return bool(_ADDRESS.match(text[end : end + 2]))


def word_features(before: int, after: int, old: str, new: str, edge: bool) -> list[str]:
    sign = not old.isalpha()
    op = "delete" if len(old) > len(new) else "insert" if len(old) < len(new) else "replace"
    return [f"w{_step(before)}>{_step(after)}", f"s{sign:d}{edge:d}", f"e{old}>{new}", f"b{_step(before)}{sign:d}", "w", f"o:{op}"]


def _join_counts(a: str, b: str, word, scale: float) -> tuple[int, int]:
    """How common, beside each other, the word of two parts and its rarer part are."""
    whole, rarer = leveled(scale, word((a + b).lower()), min(word(a.lower()), word(b.lower())))
    return whole, rarer


def join_features(a: str, b: str, word, scale: float = 1.0) -> list[str]:
    """Features of joining two lines at a hyphen: how common the word and its parts are, and how the next line begins."""
    low = b[:1].islower() or a.isupper()
    whole, rarer = _join_counts(a, b, word, scale)
    parts = min(len(a), len(b)) > 2 and rarer > 3
    return ["j", "o:join", f"j{low:d}", f"jw{_step(whole)}{parts:d}", f"jk{whole > 0:d}{parts:d}{low:d}", f"jp{parts:d}"]


def _flow(lines: list[str]) -> str:
    """Lines as one text for the editor: split words joined, Han lines joined without a space."""
    text = HYPHEN.sub(r"\1\2", "\n".join(lines))
    text = re.sub(r"(?<=[一-鿿，。！？：；、\d])[ \t]*\n[ \t]*(?=[一-鿿，。！？：；、\d])", "", text)
    return re.sub(r"[ \t]*\n[ \t]*", " ", text)


def in_one_line(text: str) -> str:
    return _flow(text.split("\n")) if "\n" in text else text


def _line_examples(texts: list[str]) -> list[tuple[list[str], bool]]:
    """Lines with the form of furniture: furniture on pages, text elsewhere."""
    out = []
    for t in texts:
        lines = t.split("\n")
        if len(lines) < 4:
            continue
        page = _joins_on(lines)
        for at, line in enumerate(lines):
            if form := _form(line):
                out.append((line_features(lines, at, form, page), page))
    # a page and a list without any example: what every sample should teach
    lines = ["The first line of a page runs", "- 7 -", "on to the next one and then", "on and on to the end of it."]
    return out + [(line_features(lines, 1, frozenset({k}), page), page) for k in ("page_number", "header") for page in (True, False)] * 3


def train(texts: list[str], counts: Counts | None = None, seed: int = 7) -> Editor:
    """Perceptrons fitted on texts with exchanged characters and split words; counts are of these texts, if not given."""
    rng = random.Random(seed)
    flows = [in_one_line(t) for t in texts]
    editor = Editor(counts or of_texts(flows), None, Perceptron.train(_line_examples(texts), rng).weights)
    flows = [_flow(editor.furniture(t)[0]) for t in texts]
    back: dict[str, list[str]] = {}
    for old, new in LATIN:
        back.setdefault(new, []).append(old)
    for pair in HAN:
        back.setdefault(pair[1], []).append(pair[0])
    examples, words = [], []
    word, scale = editor.counts.word, editor.counts.word_scale
    for t in flows[:: max(1, len(flows) // 3000)]:
        # what is proposed on the text as it is should stay; the few real misreadings in it are outvoted
        examples += [(f, False) for *_, f in editor.edits(t[:600])]
        places = [i for i, c in enumerate(t[:600]) if c in back and (c > "\x7f" or 0 < i < len(t) - 1 and t[i - 1].isalpha() and t[i + 1].isalpha())]
        for i in rng.sample(places, min(2, len(places))):
            wrong = rng.choice(back[t[i]])
            bad = t[:i] + wrong + t[i + 1 :]
            near = bad[max(0, i - 40) : i + 40]
            at = i - max(0, i - 40)
            examples += [(f, True) for a, b, n, f in editor.edits(near) if a == at and n == t[i] and b == at + len(wrong)]
        some = [w for w in TOKEN.findall(t[:600]) if w.isascii() and w.isalpha()]
        words += some
        for w in some[:4]:
            if len(w) > 4:
                k = rng.randrange(2, len(w) - 1)
                # its own place counts the word once, and a rare word should be joined as well
                seen = (lambda x: word(x)) if rng.random() < 0.7 else (lambda x, w=w: 0 if x == w.lower() else word(x))
                whole, rarer = _join_counts(w[:k], w[k:], seen, scale)
                if not (whole == 0 and rarer > 3 and min(k, len(w) - k) > 2):
                    examples.append((join_features(w[:k], w[k:], seen, scale), True))
        if len(words) > 2:
            a, b = rng.choice(words), rng.choice(words)
            whole, rarer = _join_counts(a, b, word, scale)
            if min(len(a), len(b)) > 2 and not whole and rarer > 3:
                examples += [(join_features(a, b.lower(), word, scale), False), (join_features(a.lower(), b.capitalize(), word, scale), False)]
    editor.model = Perceptron.train(examples, rng)
    return editor


def noise(text: str, editor: Editor) -> set[str]:
    lines, kinds, _ = editor.furniture(text)
    body = "\n".join(lines)
    if "\n" in body and any(editor.joins(m.group(1), m.group(2)) for m in HYPHEN.finditer(body)):
        kinds.add("hyphen")
    if editor.correct(_flow(lines) if len(lines) > 1 else body)[1]:
        kinds.add("misread")
    return kinds


def readable(text: str, editor: Editor) -> str:
    """A page as continuous paragraphs, its blank lines between them; other texts keep their lines."""
    lines, _, page = editor.furniture(text)
    body = HYPHEN.sub(lambda m: m.group(1) + m.group(2) if editor.joins(m.group(1), m.group(2)) else f"{m.group(1)}-{m.group(2)}", "\n".join(lines))
    parts = [_flow(p.split("\n")) for p in re.split(r"\n[ \t]*\n", body)] if page else [body]
    return "\n\n".join(editor.correct(p)[0] for p in parts)


def editor_of(messages: DataFrame) -> Editor:
    """An editor with the counts of all texts, trained on about ``MODEL_TEXTS`` messages, the same ones in every run."""
    raw, content = F.col("raw_ocr_text"), F.col("content")
    counts = of_corpus(messages.select(F.coalesce(F.when(F.trim(raw) != "", raw), content).alias("text")), in_one_line)
    text = F.coalesce(F.when(F.trim("raw_ocr_text") != "", raw), content)
    some = bounded_sample(messages, "seq", MODEL_TEXTS).select("seq", text.alias("t")).filter(F.length("t") > 20)
    return train([r.t for r in sorted(some.collect())], counts)


_last: list = [None, None]


def _shared(sent) -> Editor:
    """The editor of a broadcast, made once for each worker, so that what it looked up is kept from batch to batch."""
    if _last[0] is not sent.value:
        words, runs, edits, lines = sent.value
        _last[:] = sent.value, Editor(Counts(words, runs), edits, lines)
    return _last[1]


def noises(messages: DataFrame) -> DataFrame:
    """``seq, noise``: the kinds of noise in ``raw_ocr_text`` or ``content``."""
    import pyarrow as pa

    editor = editor_of(messages)
    shared = messages.sparkSession.sparkContext.broadcast((editor.counts.words, editor.counts.runs, editor.model.weights, editor.line_model.weights))

    def run(raw: pa.Array, content: pa.Array) -> pa.Array:
        editor, out = _shared(shared), []
        for a, b in zip(raw.to_pylist(), content.to_pylist()):
            out.append(sorted(set().union(*(noise(t, editor) for t in {a, b} if t))))
        return pa.array(out, pa.list_(pa.string()))

    run.__annotations__ = {"raw": pa.Array, "content": pa.Array, "return": pa.Array}
    return messages.select("seq", F.explode(F.arrow_udf(run, ArrayType(StringType()))("raw_ocr_text", "content")).alias("noise"))


def paragraphs(messages: DataFrame) -> DataFrame:
    """``seq, text``: readable text of each message, from ``raw_ocr_text`` where it holds any, else from ``content``."""
    import pyarrow as pa

    editor = editor_of(messages)
    shared = messages.sparkSession.sparkContext.broadcast((editor.counts.words, editor.counts.runs, editor.model.weights, editor.line_model.weights))

    def run(raw: pa.Array, content: pa.Array) -> pa.Array:
        editor = _shared(shared)
        texts = (a if a and a.strip() else b for a, b in zip(raw.to_pylist(), content.to_pylist()))
        return pa.array([readable(t, editor) if t else t for t in texts], pa.string())

    run.__annotations__ = {"raw": pa.Array, "content": pa.Array, "return": pa.Array}
    return messages.select("seq", F.arrow_udf(run, StringType())("raw_ocr_text", "content").alias("text"))
