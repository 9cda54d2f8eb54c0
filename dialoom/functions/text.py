"""Text functions as Column expressions; offsets are code points, spans half open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions.scalars import greedy_starts, let, prefix_sums, stretches

# Curly quotes and their straight forms; Crockford's base-32 digits.
CURLY, STRAIGHT = "’‘“”", "''\"\""
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
# Pause tags of annotated speech.
PAUSE = r"\[pause(?: (?:short|long))?\]"


def normalized(text: Column) -> Column:
    """Lower case, straight quotes, tight apostrophes, hyphens and punctuation, no outer quotes, single blanks."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), CURLY, STRAIGHT)
    t = F.regexp_replace(t, r"(\w)\s*'\s*\b(?=\w)", "$1'")
    t = F.regexp_replace(t, r"(\w)\s*-\s*\b(?=\w)", "$1-")
    t = F.regexp_replace(t, r"\s+([,.;:!?])", "$1")
    t = F.regexp_replace(t, r"^[\s\"'`]+|[\s\"'`]+$", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def phrase(text: Column) -> Column:
    """Only a-z, 0-9 and apostrophes, blanks squeezed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9']+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))


def slug(text: Column, mark: str = "_") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")


def character_name(text: Column) -> Column:
    """Names as they are compared: lower case, _ and - as blanks, no punctuation."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.trim(text)), "_-", "  "), "[^a-z0-9]+", " "))


def file_name(title: Column) -> Column:
    t = F.regexp_replace(F.trim(title), r'[<>:"/\\|?*\x00-\x1F]', "-")
    t = F.substring(F.regexp_replace(F.regexp_replace(t, "-{2,}", "-"), r"^[-. ]+|[-. ]+$", ""), 1, 80)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("unknown"))


def sentence(text: Column, last: bool) -> Column:
    """The first or last sentence: cut at blanks after . ! or ?"""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+")
    return F.element_at(parts, -1 if last else 1)


def paragraphs(text: Column) -> Column:
    """Array of (idx, start, end, text): physical lines that are not blank, cut at CRLF, LF or CR."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\r\n]*(?:\r\n|\r|\n|$)"), F.lit(0))

    line = lambda piece: F.regexp_replace(piece, r"[\r\n]+$", "")
    placed = let(pieces, lambda x: F.zip_with(x, prefix_sums(F.transform(x, lambda p: F.length(p).cast("long"))), lambda p, at: F.struct(line(p).alias("text"), at.cast("int").alias("start"))))
    kept = F.filter(placed, lambda x: F.length(F.trim(F.regexp_replace(x["text"], r"\s", " "))) > 0)
    return F.transform(kept, lambda x, i: F.struct(i.alias("idx"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"), x["text"].alias("text")))


def quotes(text: Column) -> Column:
    """Quoted stretches on one line, with their marks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('["“”][^\\n]*?["“”]'), F.lit(0))


def inside_quote(text: Column, at: Column) -> Column:
    """Whether an odd number of quotation marks stands before code point `at`."""
    return F.length(F.regexp_replace(F.substring(text, 1, at), '[^"“”]', "")) % 2 == 1


def segments(text: Column) -> Column:
    """Array of (type, value): text and pause tags in order, empty text left out."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), f"({PAUSE})", "\u0001$1\u0001")
    kept = F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")
    return F.transform(kept, lambda s: F.struct(F.when(s.rlike(f"^{PAUSE}$"), "pause").otherwise("text").alias("type"), F.trim(s).alias("value")))


def segments_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["value"]), " ")


# Articles that lead a descriptor, and words that make one vague.
ARTICLES = ("a", "an", "the")
VAGUE = ("all", "any", "each", "every", "few", "other", "same", "some")
OUTER = "\"'“”‘’.,;:!? "


def descriptor(text: Column, articles=ARTICLES, vague=VAGUE) -> Column:
    """An article-led phrase of two to six words and 80 characters at most, without vague words before the last; else null. Case stays."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " ")
    t = F.btrim(t, F.lit(OUTER))
    words = F.regexp_extract_all(F.lower(t), F.lit("[a-z]+(?:'[a-z]+)?"), F.lit(0))
    unclear = F.arrays_overlap(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.array(*map(F.lit, vague)))
    fits = (F.length(t) <= 80) & F.size(words).between(2, 6) & F.get(words, F.lit(0)).isin(*articles) & ~unclear
    return F.when(fits, t)


def dash_only(text: Column) -> Column:
    """Only one to three hyphens, of any dash."""
    return F.translate(F.trim(F.coalesce(text, F.lit(""))), "–—−", "---").isin("-", "--", "---")


def id_candidates(text: Column) -> Column:
    """Ids that a name may have had: its slug, with "the-", and both without a final s."""
    slugged = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", ""), r"[\s-]+", "-"), "^-+|-+$", "")
    both = lambda s: F.array(s, F.concat(F.lit("the-"), s))
    single = F.regexp_replace(slugged, "s$", "")
    return F.when(slugged == "", F.array().cast("array<string>")).when(slugged.endswith("s") & (F.length(slugged) > 1), F.concat(both(slugged), both(single))).otherwise(both(slugged))


def single_quoted(line: Column, endings: str = ".!?,-") -> Column:
    """A line whose paired straight quotations that do not end like speech have single quotes instead; an unpaired tail stays."""
    pieces = F.regexp_extract_all(line, F.lit('"[^"]*"|[^"]+|"[^"]*$'), F.lit(0))
    last = lambda p: F.substring(F.rtrim(F.regexp_replace(F.substring(p, 2, F.length(p) - 2), r"\s+$", "")), -1, 1)
    plain = lambda p: p.rlike('^"[^"]*"$') & (last(p) != "") & (F.instr(F.lit(endings), last(p)) == 0)
    return F.array_join(F.transform(pieces, lambda p: F.when(plain(p), F.concat(F.lit("'"), F.substring(p, 2, F.length(p) - 2), F.lit("'"))).otherwise(p)), "")


# English cardinals.
ONES = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


def cardinal(n: Column) -> Column:
    """0 to 9999 in English words, null beyond."""
    ones, tens = (F.array(*map(F.lit, words)) for words in (ONES, TENS))
    at = lambda words, i: F.get(words, i.cast("int"))
    below100 = lambda x: F.when(x < 20, at(ones, x)).when(x % 10 == 0, at(tens, x / 10)).otherwise(F.concat_ws(" ", at(tens, F.floor(x / 10)), at(ones, x % 10)))
    hundreds = lambda x: F.concat(at(ones, F.floor(x / 100)), F.lit(" hundred"))
    below1000 = lambda x: F.when(x < 100, below100(x)).when(x % 100 == 0, hundreds(x)).otherwise(F.concat(hundreds(x), F.lit(" and "), below100(x % 100)))
    thousands = F.concat(at(ones, F.floor(n / 1000)), F.lit(" thousand"))
    link = F.when(n % 1000 < 100, " and ").otherwise(" ")
    return F.when((n < 0) | (n > 9999), None).when(n < 1000, below1000(n)).when(n % 1000 == 0, thousands).otherwise(F.concat(thousands, link, below1000(n % 1000)))


def numbers_in_words(text: Column) -> Column:
    """Numbers up to 9999 that stand by themselves in English words, their commas left out; others stay."""
    cut = "\x01"
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), cut, " "), r"(?U)(?<![\w.])\d[\d,]*(?![\w.])", f"{cut}$0{cut}")
    value = lambda p: F.replace(p, F.lit(","), F.lit("")).try_cast("int")
    # numbers are every second piece
    return F.array_join(F.transform(F.split(marked, cut), lambda p, i: F.when(i % 2 == 1, F.coalesce(cardinal(value(p)), p)).otherwise(p)), "")


def chapter_number(name: Column) -> Column:
    """The number that a folder's name begins with, null if none."""
    return F.nullif(F.regexp_extract(F.trim(name), r"^(\d+)", 1), F.lit("")).try_cast("int")


def model_answer(raw: Column) -> Column:
    """A model's reply without code fences, labels and outer punctuation; first line only."""
    t = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), "```[a-z]*", ""))
    t = F.regexp_replace(F.element_at(F.split(t, "\n"), 1), r"(?i)^\s*(?:answer|speaker|character)\s*[:=]\s*", "")
    return F.regexp_replace(t, r"^[\s\"'`*.,;:]+|[\s\"'`*.,;:]+$", "")


def natural_key(text: Column) -> Column:
    """A text whose order counts digits as numbers."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(r)), "")


def guid(seed: Column) -> Column:
    """Eight base-32 digits: the first five bytes of a SHA-256."""
    bits = F.lpad(F.conv(F.substring(F.sha2(seed, 256), 1, 10), 16, 2), 40, "0")
    digit = lambda k: F.substring(F.lit(CROCKFORD), F.conv(F.substring(bits, 5 * k + 1, 5), 2, 10).cast("int") + F.lit(1), F.lit(1))
    return F.concat(*(digit(k) for k in range(8)))


def is_guid(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^[{CROCKFORD}]{{8}}$"), F.lit(False))


def spoken_text(text: Column) -> Column:
    """Text as it is read out: straight signs, spelled levels and plus values, brackets and dashes as pauses, single blanks."""
    # The patterns, what stands for them, and their order.
    t = F.replace(F.translate(F.coalesce(text, F.lit("")), "‘’“”–—", "''\"\"--"), F.lit("…"), F.lit("..."))
    t = F.regexp_replace(t, r"(?U)[\[(]\s*\?{3}\s*[\])]", " unknown ")
    t = F.regexp_replace(t, r"(?iU)\blvl\.?\b", "level")
    t = F.regexp_replace(t, r"(?U)(?<!\w)\+(\d[\d,]*(?:\.\d+)?)", "plus $1")
    t = F.regexp_replace(t, r"(?U),(?=['\"](?:\s|$))", ".")
    t = F.regexp_replace(t, r"(?U):\s*(?=[\[(])", " ... ")
    t = F.regexp_replace(t, r"[\[\]()]", " ... ")
    t = F.regexp_replace(t, r"(?U)\s-\s", " ... ")
    t = F.regexp_replace(t, r"(?iU),\s*(?=plus\b)", " ... ")
    t = F.regexp_replace(t, r"(?U)(?:\s*\.\.\.\s*)+", " ... ")
    t = F.regexp_replace(t, r"(?U)\s+([,;:!?])", "$1")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def line_query(text: Column, start: Column, end: Column, last_speaker: Column, reach: int) -> Column:
    """The line in <quote> tags with `reach` characters on either side, after the last speaker if there is one; null for no span."""
    begin = F.greatest(F.lit(0), start - reach)
    state = F.concat(F.substring(text, begin + 1, start - begin), F.lit("<quote>"), F.substring(text, start + 1, end - start), F.lit("</quote>"), F.substring(text, end + 1, F.lit(reach)))
    state = F.regexp_replace(state, r"(?U)^\s+|\s+$", "")
    head = F.when(F.coalesce(last_speaker, F.lit("")) != "", F.concat(F.lit("[Last speaker: "), last_speaker, F.lit("]\n"))).otherwise("")
    return F.when((end > start) & (start < F.length(text)), F.concat(head, state))


def run_query(text: Column, spans: Column, reach: int) -> Column:
    """Text from `reach` characters before the first of spans, an array of (start, end), to as many after the last one, each marked as <qK>.

    K is a span's place in the array. Marks are put in from the last start to the first, so that spans that overlap are marked as the
    text then stands. Null for no spans, an empty or reversed one, or one outside the text.
    """
    marks = F.transform(spans, lambda s, k: F.struct(s["start"].alias("start"), s["end"].alias("end"), k.alias("k")))
    begin, end = F.array_min(F.transform(spans, lambda s: s["start"])), F.array_max(F.transform(spans, lambda s: s["end"]))
    low, high = F.greatest(F.lit(0), begin - reach), F.least(F.length(text), end + reach)
    fits = F.forall(spans, lambda s: (s["end"] > s["start"]) & (s["start"] >= 0) & (s["end"] <= high))

    def mark(state: Column, m: Column) -> Column:
        at, to, tag = m["start"] - low, m["end"] - low, F.concat(F.lit("q"), m["k"].cast("string"), F.lit(">"))
        return F.concat(F.substring(state, F.lit(1), at), F.lit("<"), tag, F.substring(state, at + 1, to - at), F.lit("</"), tag, F.substring(state, to + 1, F.length(state)))

    state = F.aggregate(F.sort_array(marks, asc=False), F.substring(text, low + 1, high - low), mark)
    return F.when((F.size(spans) > 0) & (end > begin) & (begin < F.length(text)) & fits, state)


def _filled(items: Column, most: int) -> Column:
    """Items joined by blanks into as few texts, in order, as have `most` characters at most."""
    joined = lambda x, starts: stretches(starts, F.size(x), lambda k, first, n: F.array_join(F.slice(x, first + 1, n), " "))
    return let(items, lambda x: let(greedy_starts(F.transform(x, F.length), most), lambda starts: joined(x, starts)))


def fitting_pieces(text: Column, most: int) -> Column:
    """Pieces of at most `most` characters, cut at sentences, else at words; a longer word stays whole, a null gives none."""
    words = lambda s: F.regexp_extract_all(s, F.lit(r"(?U)\S+"), F.lit(0))
    sentences = F.split(text, r"(?U)(?<=[.!?])\s+", -1)
    fitting = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(_filled(words(s), most))))
    return F.when(text.isNotNull(), F.when(F.length(text) <= most, F.array(text)).otherwise(_filled(fitting, most)))
