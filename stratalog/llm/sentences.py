"""Sentence boundaries in commit messages of many languages and scripts.

Two passes over all messages. The first learns, per language and without labels, from counts of every period and the word
after it: sentence starters (words drawn to the place after sure sentence ends), abbreviations (types drawn to a period that go
on like the middle of a sentence, not like its end) and collocations across a period (``2. Lauf``), each by a log-likelihood
ratio (Dunning) against its language. Counting is a map-side aggregate in the workers and one shuffle of counts; the ratios
are column expressions. The learned lists are written to the shared folder, where the second pass reads them.

The second pass cuts each message into lines, paragraphs and list items and classifies each sentence mark by the lists, the
marks around it and the next word. The language is that of the paragraph, as labels are often wrong or missing: by script where
one language stands for a script, by the script's name where none does, and among the languages of Latin script by a naive Bayes
vote of frequent words. Its vocabularies are learned from all messages by their labels, so any language with labelled messages has
one; a word is frequent by its share of a label's words. No list of words is given.

Defined results: null, empty and blank texts and texts that begin with a diff have no sentences. Only a line feed (after an optional
carriage return) ends a line. Positions are code points of the whole text. Repeated rows give repeated sentences; with few texts
little is learned and the fixed rules decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.session import new_path, qualified, settle, spread

#: Levels of the log-likelihood ratios: starters strict, the others at p < 0.005 (chi-square, 1 degree of freedom).
STARTER_LLR, LLR = 30.0, 7.88
#: Share of a type's periods that must go on inside the sentence, and share of its occurrences that must have a period.
GOES_ON, COHESION = 0.25, 0.3
#: Share of a lower-case word's occurrences that must begin sentences for it to be a starter.
STARTER_SHARE = 0.3
#: The lists are learned from sure ends, then again from all ends that the first lists leave.
ROUNDS = 2
#: Periods after words of so many letters are taken for ends when the first starters are learned; such a word can be an abbreviation all the same.
LONG_WORD = 15
#: Share of a label's words from which a word is frequent, and share of Latin letters from which a label's language is written so.
FREQUENT, LATIN_SHARE = 1 / 2000, 0.5
#: How far a label is believed before a word is read.
LABEL_TRUST = 0.9
#: Codes that name no language (fixed values of the standard for language codes).
NO_LANGUAGE = ("und", "mul", "mis", "zxx")
DIFF = "diff --git "

OPENERS = "([{\"'“‘„«‹「『（《【〈¿¡"
CLOSERS = ")]}\"'”’“»›」』）》】〉"
QUOTES = "\"”“»›」』’'"
COMMAS = ",;:，、；：،؛"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "《": "》", "【": "】"}
BRACKETS = "([（【"
FULL = "。！？｡"
_STATE: dict = {}


def _patterns():
    """Compiled once in each worker."""
    if "p" not in _STATE:
        import re

        import regex

        word = r"\p{L}[\p{L}\p{M}]*+"
        _STATE["p"] = {
            "end": regex.compile(r"[.!?…。！？｡।॥؟۔]+|(?<=\s)[:;]-?[)(](?=\s)|(?<=[ก-๎])\s+(?=[ก-๎])"),
            "bullet": regex.compile(r"\s*[-*+•]\s+(?=\S)"),
            "number": regex.compile(r"\s*(\d{1,4})[.)]\s+(?=\S)"),
            "trailer": regex.compile(r"[^\s:]\S*:[ \t]+\S"),
            "type": regex.compile(rf"{word}(?:\.{word})*+"),
            "inner": regex.compile(r"(?:\p{L}\p{M}*){1,3}(?:\.(?:\p{L}\p{M}*){1,3})+"),
            "single": regex.compile(r"\p{L}\p{M}*"),
            "figure": regex.compile(r"\d[\d.,]*"),
            "plain": regex.compile(rf"\p{{Ll}}[\p{{L}}\p{{M}}]*+(?:['’-]{word})*"),
            "word": regex.compile(rf"{word}(?:['’-]{word})*"),
            "letters": re.compile(r"[^\W\d_]+"),
            "foreign": regex.compile(r"[\p{L}--[\p{Latin}\p{Lm}ªº]]", regex.V1),
            "scripts": [(k, re.compile(v)) for k, v in (("ja", "[぀-ヿ]"), ("ko", "[가-힣]"), ("zh", "[一-鿿]"), ("th", "[ก-๎]"), ("hi", "[ऀ-ॣ०-ॿ]"), ("ar", "[ؠ-ۿ]"), ("ru", "[Ѐ-ӿ]"))],
        }
    return _STATE["p"]


def plain_label(label: str | None) -> str:
    """The language of a label, '' for none."""
    short = (label or "").strip().lower().replace("_", "-").split("-")[0]
    return short if 2 <= len(short) <= 3 and short.isascii() and short.isalpha() and short not in NO_LANGUAGE else ""


class Tongues:
    """Languages of Latin script and the counts of their frequent words: rows (label, words of the label, word, count)."""

    def __init__(self, rows=()):
        from math import log

        totals, counts = {}, {}
        for label, total, word, n in rows:
            totals[label] = total
            counts.setdefault(word, {})[label] = n
        self.labels = sorted(totals)
        size, whole = len(counts), sum(totals.values())
        self.place = {x: i for i, x in enumerate(self.labels)}
        self.weights = {w: [log((c.get(x, 0) + 0.5) / (totals[x] + 0.5 * size)) for x in self.labels] for w, c in counts.items()}
        share = [totals[x] / whole for x in self.labels]
        self.priors = {"": [log(p) for p in share]}
        for i, x in enumerate(self.labels):
            self.priors[x] = [log(LABEL_TRUST + (1 - LABEL_TRUST) * p if i == j else (1 - LABEL_TRUST) * p) for j, p in enumerate(share)]

    @classmethod
    def read(cls, uri: str) -> Tongues:
        return _read("tongues", uri, ("label", "total", "w", "n"), cls)

    def pick(self, text: str, label: str) -> str:
        if not self.labels:
            return label
        score = self.priors.get(label, self.priors[""])
        for word in _patterns()["letters"].findall(text.lower()):
            if w := self.weights.get(word):
                score = [a + b for a, b in zip(score, w, strict=True)]
        if label and label not in self.place and score is self.priors[""]:
            return label  # nothing known of the words: the label's own language
        return self.labels[max(range(len(score)), key=score.__getitem__)]


def language(text: str, label: str | None, tongues: Tongues) -> str:
    """Language of a paragraph: by script, for Latin script by the vote of its words and its label."""
    p = _patterns()
    for name, found in p["scripts"]:
        if found.search(text):
            return name
    if other := p["foreign"].search(text):
        import unicodedata

        return unicodedata.name(other[0], "other").split()[0].lower()  # a script's own statistics
    return tongues.pick(text, plain_label(label))


def _read(slot: str, uri: str, columns: tuple[str, ...], made):
    """What a worker has read last of a kind; a table of an earlier query gives way to the new one."""
    if _STATE.get(slot, ("", None))[0] != uri:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        t = ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=True).to_table(columns=list(columns))
        _STATE[slot] = (uri, made(zip(*(t.column(c).to_pylist() for c in columns), strict=True)))
    return _STATE[slot][1]


def segments(message: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, where its words start, is one sentence): subject, list items, trailer lines, and what is left of paragraphs."""
    p = _patterns()
    lines, at = [], 0
    for line in message.split("\n"):
        lines.append((at, at + len(line), line))
        at += len(line) + 1
    out, i, number, first = [], 0, 0, True
    while i < len(lines):
        if not lines[i][2].strip():
            i += 1
            continue
        j = i
        while j < len(lines) and lines[j][2].strip():
            j += 1
        block, i = lines[i:j], j
        if first:
            first = False
            out.append((block[0][0], block[0][1], block[0][0], False))
            block = block[1:]
            if not block:
                continue
        elif all(p["trailer"].match(x[2]) for x in block):
            out += [(a, b, a, True) for a, b, _ in block]
            continue
        figures = [(m, int(m[1])) if (m := p["number"].match(x[2])) else None for x in block]
        begin, here = None, False
        for n, (a, b, line) in enumerate(block):
            mark = p["bullet"].match(line)
            if not mark and figures[n]:
                found, value = figures[n]
                later = next((f[1] for f in figures[n + 1 :] if f), None)
                ended = n == 0 or block[n - 1][2].rstrip()[-1] in ".!?…:" + CLOSERS or ord(block[n - 1][2].rstrip()[-1]) > 0x500
                if (number and value == number + 1 and (here or n == 0)) or (value == 1 and (later == 2 or ended)):
                    mark, number, here = found, value, True
            if mark:
                if begin is not None:
                    out.append((begin[0], a, begin[1], False))
                begin = (a, a + mark.end())
            elif begin is None:
                begin = (a, a)
        out.append((begin[0], block[-1][1], begin[1], False))
    return out


def _spans(text: str) -> list[tuple[int, int]]:
    """Pairs of quotes and brackets; what has no partner is left out."""
    out, stack, waiting = [], [], Counter()  # waiting: closing marks that would close something
    straight = [i for i, c in enumerate(text) if c == '"']
    if len(straight) % 2 == 0:
        out += zip(straight[::2], straight[1::2], strict=True)

    def close(i: int) -> None:
        opened = stack.pop()
        waiting.subtract(PAIRS[text[opened]])
        out.append((opened, i))

    for i, c in enumerate(text):
        if stack and c in PAIRS[text[stack[-1]]]:
            close(i)
        elif c in PAIRS:
            stack.append(i)
            waiting.update(PAIRS[c])
        elif c in ")]）】」』»”" and waiting[c] > 0:
            while c not in PAIRS[text[stack[-1]]]:
                waiting.subtract(PAIRS[text[stack.pop()]])
            close(i)
    return sorted(out)


class Model:
    """The learned lists."""

    def __init__(self, rows=(), tongues: Tongues | None = None):
        self.tongues = tongues or Tongues()
        self.abbreviations, self.starters, self.collocations, self.ordinary = set(), set(), set(), set()
        for lang, kind, a, b in rows:
            if kind == "abbreviation":
                self.abbreviations.add((lang, a))
            elif kind == "starter":
                self.starters.add((lang, a))
            elif kind == "ordinary":
                self.ordinary.add((lang, a))
            else:
                self.collocations.add((lang, a, b))

    @classmethod
    def read(cls, uri: str, tongues: str) -> Model:
        out = _read("model", uri, ("lang", "kind", "a", "b"), cls)
        out.tongues = Tongues.read(tongues)
        return out


def _core(token: str) -> str:
    return token.lstrip(OPENERS).rstrip(CLOSERS + COMMAS + ".!?…")


def _breaks(text: str, begin: int, lang: str, model: Model) -> list[int]:
    """Ends of the sentences inside a segment, the last one aside; ``begin`` is where its words start."""
    p = _patterns()
    spans, open_spans, taken = None, [], 0
    out, last, size = [], begin, len(text)
    for m in p["end"].finditer(text, begin):
        mark, a, j = m[0], m.start(), m.end()
        thai = mark[0].isspace()
        smile = mark[0] in ":;"
        if spans is None:
            spans = _spans(text)
            closing: dict[int, list[int]] = {}
            for o, c in spans:
                closing.setdefault(c, []).append(o)
        while j < size and text[j] in CLOSERS and not thai and not smile and (text[j] not in '"“' or j in closing):
            j += 1
        if not thai and j + 1 < size and text[j].isspace() and text[j + 1] == "»" and j + 1 in closing and any(o < a for o in closing[j + 1]):
            j += 2
        k = j
        while k < size and text[k].isspace():
            k += 1
        if k >= size:
            break
        if thai:
            j = a
        elif p["end"].match(text, j) and not text[j].isspace():
            continue  # the mark that follows the quote decides
        spaced, after = k > j, text[k]
        east = a > 0 and "぀" <= text[a - 1] <= "鿿"
        cjk = mark[0] in FULL or (east and (after >= "぀" or "…" in mark))
        if not spaced and not cjk and mark[0] not in "।॥؟۔":
            continue
        if after in COMMAS:
            continue
        # spans that began before this mark and have not ended before it, outermost first
        while taken < len(spans) and spans[taken][0] < a:
            open_spans.append(spans[taken])
            taken += 1
        open_spans = [s for s in open_spans if s[1] >= a]
        inside = [s for s in open_spans if s[1] >= j]
        if any(text[s[0]] not in BRACKETS or text[last : s[0]].strip() for s in inside):
            continue
        token = text[k:].split(None, 1)[0]
        core = _core(token)
        lower = bool(p["plain"].fullmatch(core)) and (lang, core) not in model.starters
        quoted = [s for s in open_spans if s[1] < j and text[s[0]] not in BRACKETS]
        if thai:
            pass
        elif quoted:
            opened = min(s[0] for s in quoted)
            letter = core[:1] or after
            if letter.isalpha() and letter.lower() == letter.upper():
                if text[:opened].rstrip()[-1:] not in (":", "："):
                    continue
            elif lower:
                continue
        elif j > m.end() and lower:
            continue
        elif smile or "…" in mark or ".." in mark:
            if lower and not east:
                continue
        elif mark == ".":
            left = text[last:a].rsplit(None, 1)
            kind = left[-1].lstrip(OPENERS).lower() if left and not text[a - 1].isspace() else ""
            if p["figure"].fullmatch(kind):
                if lower or (lang, "##", core) in model.collocations:
                    continue
            elif (lang, kind) in model.abbreviations or p["inner"].fullmatch(kind) or (p["single"].fullmatch(kind) and (lang, kind) not in model.ordinary):
                if (lang, core) not in model.starters or (lang, kind, core) in model.collocations:
                    continue
            elif (lang, kind, "##") in model.collocations and p["figure"].fullmatch(core):
                continue
        out.append(j)
        last = j
    return out


def split_message(message: str, label: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence, trimmed of white space."""
    out = []
    for start, end, words, single in segments(message):
        text = message[start:end]
        cuts = [] if single else _breaks(text, words - start, language(text, label, model.tongues), model)
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            part = text[a:b]
            if kept := part.strip():
                at = start + a + len(part) - len(part.lstrip())
                out.append((at, at + len(kept)))
    return out


def count_message(message: str, label: str | None, words: Counter, pairs: Counter, tongues: Tongues) -> None:
    """Add a message's words and what follows each of its periods and sure sentence ends."""
    p = _patterns()
    for start, end, begin, single in segments(message):
        if single:
            continue
        text = message[begin:end]
        lang = language(text, label, tongues)
        tokens = text.split()
        cores = [_core(t) for t in tokens]
        known = [c if p["word"].fullmatch(c) else "" for c in cores]
        if begin == start and start and known[0]:
            pairs[lang, "#start", known[0]] += 1
        for i, t in enumerate(tokens):
            bare = t.rstrip(CLOSERS)
            final = bare[-1:]
            if known[i] and final != ".":
                words[lang, known[i]] += 1
            if final not in ".!?।؟。！？" or not final:
                continue
            if bare != t and any(c in QUOTES for c in t[len(bare) :]):
                continue  # the end of a quotation says nothing about its sentence
            kind = bare[:-1].lstrip(OPENERS).lower()
            if final != ".":
                left = "#!"
            elif p["figure"].fullmatch(kind):
                left = "##"
            elif p["type"].fullmatch(kind):
                left = kind
            elif kind[-1:] in ".…" or not kind:
                continue
            else:
                left = "#id"
            if i + 1 == len(tokens):
                right = "#end"
            elif known[i + 1]:
                right = known[i + 1]
            elif p["figure"].fullmatch(cores[i + 1]):
                right = "##"
            else:
                right = "#path" if "/" in cores[i + 1] else "#id"
            pairs[lang, left, right] += 1


def _count(uri: str):
    return lambda batches: _count_batches(batches, Tongues.read(uri))


def _count_batches(batches: Iterator, tongues: Tongues) -> Iterator:
    import pyarrow as pa

    words, pairs = Counter(), Counter()

    def out():
        rows = [(k[0], "", k[1], n) for k, n in words.items()] + [(*k, n) for k, n in pairs.items()]
        words.clear()
        pairs.clear()
        for i in range(0, len(rows), 50_000):
            lang, a, b, n = zip(*rows[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_pydict({"lang": list(lang), "a": list(a), "b": list(b), "n": pa.array(n, pa.int64())})

    for b in batches:
        for message, label in zip(b.column("message").to_pylist(), b.column("lang").to_pylist(), strict=True):
            if message:
                count_message(message, label, words, pairs, tongues)
        if len(words) + len(pairs) > 200_000:
            yield from out()
    yield from out()


def likelihood_ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's ratio for two binomials; negative where the first rate is not the higher."""

    def part(k, n, p):
        left = F.when(k > 0, k * F.log(p)).otherwise(0.0)
        return left + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(0.0)

    p1, p2, p = F.when(n1 > 0, k1 / n1).otherwise(F.lit(0.0)), F.when(n2 > 0, k2 / n2).otherwise(F.lit(0.0)), F.when(n1 + n2 > 0, (k1 + k2) / (n1 + n2)).otherwise(F.lit(0.0))
    ratio = 2 * (part(k1, n1, p1) + part(k2, n2, p2) - part(k1, n1, p) - part(k2, n2, p))
    return F.when(p1 > p2, ratio).otherwise(-ratio)


def shortfall(k: Column, n: Column, share: float) -> Column:
    """The likelihood ratio of a rate against a share that it lies below; 0 where it does not."""
    p = k / n
    left = F.when(k > 0, k * F.log(p / share)).otherwise(0.0)
    return F.when((n > 0) & (p < share), 2 * (left + (n - k) * F.log((1 - p) / (1 - share)))).otherwise(0.0)


def learn_tongues(messages: DataFrame) -> DataFrame:
    """(label, total, w, n): counts of the frequent words of each labelled language of Latin script. At most 1 / FREQUENT words a label."""
    label = F.split(F.lower(F.trim("lang")), "[-_]")[0]
    words = messages.select(label.alias("label"), F.explode(F.split(F.lower("message"), "[^\\p{L}]+")).alias("w"))
    counts = settle(words.where(F.col("label").rlike("^[a-z]{2,3}$") & ~F.col("label").isin(*NO_LANGUAGE) & (F.col("w") != "")).groupBy("label", "w").agg(F.count("*").alias("n")), "label-words")
    latin = F.col("w").rlike("^\\p{IsLatin}+$")
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"), F.sum(F.when(latin, F.col("n")).otherwise(0)).alias("latin")).where(F.col("latin") >= LATIN_SHARE * F.col("total")).select("label", "total")
    own = counts.where(latin).join(F.broadcast(totals), "label")  # a row per label
    frequent = own.where((F.col("n") >= FREQUENT * F.col("total")) & (F.col("n") > 1)).select("w").distinct()
    return own.join(frequent, "w", "left_semi").select("label", "total", "w", "n")


def learn(messages: DataFrame, tongues: str) -> DataFrame:
    """(lang, kind, a, b): the lists learned from (message, lang), by the languages in the table at ``tongues``."""
    counts = settle(messages.select("message", "lang").mapInArrow(_count(tongues), "lang string, a string, b string, n bigint").groupBy("lang", "a", "b").agg(F.sum("n").alias("n")), "sentence-counts")
    c = F.col
    pairs = counts.where("a <> ''")
    named = ~c("b").startswith("#")
    # a row per word: all occurrences, those behind a sentence mark, and those without a period
    totals = settle(
        counts.where((c("a") == "") | named).groupBy("lang", c("b").alias("w"))
        .agg(F.sum("n").alias("n"), F.sum(F.when(c("a") != "", c("n")).otherwise(0)).alias("behind"), F.sum(F.when(c("a") == "", c("n")).otherwise(0)).alias("plain")), "sentence-words"
    )
    bare = settle(totals.groupBy("lang", F.lower("w").alias("a")).agg(F.sum("plain").alias("without")), "sentence-bare")
    size = _by_language(totals.groupBy("lang").agg(F.sum("n").alias("size")))("size")
    left = settle(pairs.groupBy("lang", "a").agg(F.sum("n").alias("n1"), F.sum(F.when(c("b") == "##", c("n")).otherwise(0)).alias("k1")), "sentence-left")

    # a capitalised word that is otherwise written small, and hardly ever large inside a sentence, begins one
    small = totals.where(c("w") == F.lower("w")).select("lang", c("w").alias("small"), c("n").alias("small_n"))
    capital = totals.where("behind > 0").withColumn("small", F.lower("w")).where("w <> small").join(small, ["lang", "small"])
    capital = settle(capital.where((c("small_n") >= 3) & (c("n") - c("behind") <= c("small_n") * 0.2)).select("lang", "w"), "sentence-capitals")
    sure = pairs.where(f"(a IN ('#!', '#id', '#start') OR (length(a) >= {LONG_WORD} AND a NOT LIKE '%.%')) AND b <> '#end'")
    for _ in range(ROUNDS):
        after = settle(sure.groupBy("lang", c("b").alias("w")).agg(F.sum("n").alias("k")), "sentence-after")
        ends = _by_language(after.groupBy("lang").agg(F.sum("k").alias("ends")))("ends")
        starters = (
            after.where(~c("w").startswith("#")).join(totals, ["lang", "w"]).withColumns({"_ends": ends, "_size": size})
            .withColumn("llr", likelihood_ratio(c("k"), c("_ends"), F.greatest(c("n") - c("k"), F.lit(0)), F.greatest(c("_size") - c("_ends"), F.lit(1))))
            .where((c("llr") >= LLR) & (c("k") / c("n") >= F.when(c("w") == F.lower("w"), STARTER_SHARE).when(c("llr") >= STARTER_LLR, 0.1).otherwise(0.3))).select("lang", "w")
        )
        starters = settle(starters.union(capital).distinct(), "sentence-starters")

        # a period goes on inside its sentence if a lower-case word, a figure, a path or an upper-case word that is no starter follows
        begins = starters.select("lang", c("w").alias("b"), F.lit(True).alias("begins"))
        going = pairs.join(begins, ["lang", "b"], "left").withColumn("on", F.when((c("b") == "##") | (c("b") == "#path"), c("n")).when(c("b").startswith("#"), 0).when(c("begins"), 0).otherwise(c("n")))
        kinds = settle(going.groupBy("lang", "a").agg(F.sum("on").alias("on"), F.sum("n").alias("per")), "sentence-kinds")
        marked, typed = F.col("a").isin("#!", "#id"), ~F.col("a").startswith("#")
        rates = _by_language(kinds.groupBy("lang").agg(*(F.sum(F.when(which, c(x)).otherwise(0)).alias(name) for which, x, name in ((marked, "on", "on2"), (marked, "per", "per2"), (typed, "per", "all_per")))))
        types = kinds.where(typed).join(bare, ["lang", "a"], "left").na.fill(0, ["without"])
        abbreviations = (
            types.withColumns({"_size": size} | {f"_{x}": rates(x) for x in ("all_per", "on2", "per2")})
            .withColumn("cohesion", likelihood_ratio(c("per"), c("per") + c("without"), F.greatest(c("_all_per") - c("per"), F.lit(0)), F.greatest(c("_size") - c("per") - c("without"), F.lit(1))))
            .withColumn("goes_on", likelihood_ratio(c("on"), c("per"), c("_on2"), c("_per2")))
            .where((c("cohesion") >= LLR) & (c("goes_on") >= LLR) & (c("on") / c("per") >= GOES_ON) & (c("per") / (c("per") + c("without")) >= COHESION))
            .select("lang", F.lit("abbreviation").alias("kind"), "a", F.lit("").alias("b"))
        )
        abbreviations = settle(abbreviations, "sentence-abbreviations")
        # the next round takes every period for an end that isn't a figure's, an abbreviation's or a single letter's
        sure = pairs.where("a <> '##' AND b <> '#end' AND (a LIKE '#%' OR length(a) > 1)").join(abbreviations.select("lang", "a"), ["lang", "a"], "left_anti")
    collocations = (
        pairs.where("a = '##' OR length(a) = 1").unionByName(pairs.join(abbreviations.select("lang", "a"), ["lang", "a"], "left_semi")).distinct().where(named).join(starters.withColumnRenamed("w", "b"), ["lang", "b"], "left_anti").join(left, ["lang", "a"])
        .join(totals.select("lang", c("w").alias("b"), c("n").alias("total")), ["lang", "b"]).withColumn("_size", size)
        .withColumn("llr", likelihood_ratio(c("n"), c("n1"), F.greatest(c("total") - c("n"), F.lit(0)), F.greatest(c("_size") - c("n1"), F.lit(1))))
        .where((c("llr") >= LLR) & (c("n") > 1)).select("lang", F.lit("collocation").alias("kind"), "a", "b")
    )
    # a type whose periods stand before figures far more often than sure ends do (No. 7), whatever else it means
    ends = _by_language(left.where(marked).groupBy("lang").agg(F.sum("k1").alias("k2"), F.sum("n1").alias("n2")))
    figures = left.where(typed & (c("k1") > 0)).withColumns({"_k2": ends("k2"), "_n2": ends("n2")}).where((likelihood_ratio(c("k1"), c("n1"), c("_k2"), c("_n2")) >= LLR) & (c("k1") / c("n1") >= 0.5)).select("lang", F.lit("collocation").alias("kind"), "a", F.lit("##").alias("b"))
    # a single letter counts as an abbreviation unless a share that abbreviations need is too low to be chance
    against = F.greatest(shortfall(c("on"), c("per"), GOES_ON), shortfall(c("per"), c("per") + c("without"), COHESION))
    ordinary = types.where((F.length("a") == 1) & (against >= LLR)).join(abbreviations.select("lang", "a"), ["lang", "a"], "left_anti").select("lang", F.lit("ordinary").alias("kind"), "a", F.lit("").alias("b"))
    return starters.select("lang", F.lit("starter").alias("kind"), c("w").alias("a"), F.lit("").alias("b")).unionByName(abbreviations).unionByName(collocations).unionByName(figures).unionByName(ordinary)


def _by_language(sums: DataFrame):
    """Columns of sums per language, looked up by the row's language: a row per language comes to the driver. 0 where a language has none."""
    rows = sums.collect()

    def column(name: str) -> Column:
        if not rows:
            return F.lit(0).cast("bigint")
        return F.coalesce(F.element_at(F.create_map(*(x for r in rows for x in (F.lit(r["lang"]), F.lit(r[name]).cast("bigint")))), F.col("lang")), F.lit(0).cast("bigint"))

    return column


def _split(uri: str, tongues: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = Model.read(uri, tongues)
        for b in batches:
            ids, starts, ends = [], [], []
            for doc, message, label in zip(b.column("id").to_pylist(), b.column("message").to_pylist(), b.column("lang").to_pylist(), strict=True):
                for a, z in split_message(message, label, model) if message else ():
                    ids.append(doc)
                    starts.append(a)
                    ends.append(z)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "sent_start": pa.array(starts, pa.int64()), "sent_end": pa.array(ends, pa.int64())})

    return run


def messages_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, message, lang): the text before its first diff line, cut in the JVM so that diffs never reach a worker."""
    text = F.col(f"`{text_col}`")
    message = F.when(text.startswith(DIFF), F.lit("")).otherwise(F.substring_index(text, "\n" + DIFF, 1))
    return spread(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), message.alias("message"), F.col(f"`{lang_col}`").alias("lang")).where("message <> ''"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, sent_start, sent_end) of every sentence of every message."""
    spark = docs.sparkSession
    # both passes read the messages, a fraction of the texts; they are cut from them once
    messages = spread(settle(messages_of(docs, id_col, text_col, lang_col), "messages"))
    tongues, uri = qualified(spark, new_path(spark, "sentence-tongues")), qualified(spark, new_path(spark, "sentence-model"))
    learn_tongues(messages).write.parquet(tongues)
    learn(messages, tongues).write.parquet(uri)
    return messages.mapInArrow(_split(uri, tongues), "id bigint, sent_start bigint, sent_end bigint").withColumnRenamed("id", id_col)
