"""SEO judge: keyword presence, number and distribution, over-optimisation and semantic closeness."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from vellum.functions import html, matching, rules, shares, text
from vellum.functions.settings import RULES, Settings
from vellum.operators import services

#: An encoder turns a column of texts (an array of strings) into an array of vectors of the same length.
Encoder = Callable[[Column], Column]


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def weighted_score(similarities: Column) -> Column:
    """0 to 100 from the best similarities in falling order; half to even; 0 if there are none."""
    weights = F.slice(F.array(*map(F.lit, rules.CHUNK_WEIGHTS)), F.lit(1), F.least(F.size(similarities), F.lit(len(rules.CHUNK_WEIGHTS))))
    used = F.zip_with(F.slice(similarities, F.lit(1), F.size(weights)), weights, lambda s, w: s * w)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(similarities) == 0, 0).otherwise(F.bround(100 * add(used) / add(weights)).cast("int"))


def python_encoder(encode: Callable[[list[str]], list[list[float]]]) -> Encoder:
    """An encoder from a Python function of texts, called once for the distinct texts of each Arrow batch.

    Where it fails, the rows of that batch have null vectors: nothing semantic is available for them.
    """

    @F.arrow_udf("array<array<double>>")
    def run(asked: pa.Array) -> pa.Array:
        rows = asked.to_pylist()
        distinct = list(dict.fromkeys(t for r in rows for t in r or ()))
        try:
            known = dict(zip(distinct, encode(distinct), strict=True)) if distinct else {}
        except Exception:  # noqa: BLE001 - whatever a model raises concerns these rows alone
            return pa.nulls(len(rows), pa.list_(pa.list_(pa.float64())))
        return pa.array([None if r is None else [[float(x) for x in known[t]] for t in r] for r in rows], pa.list_(pa.list_(pa.float64())))

    return run


_COUNT = pa.struct([("keyword", pa.string()), ("n", pa.int32())])
_SENTENCE = pa.struct([("sentence_id", pa.int32()), ("text", pa.string()), ("exact", pa.bool_())])
_LEXICAL = pa.struct([
    ("keyword", pa.string()), ("body", pa.int32()), ("introduction", pa.int32()), ("headings", pa.int32()), ("conclusion", pa.int32()),
    ("minor", pa.list_(_COUNT)), ("secondary", pa.list_(_COUNT)), ("long_tail", pa.list_(_COUNT)),
    ("distribution", pa.list_(pa.struct([("h2", pa.string()), ("matched", pa.list_(pa.string()))]))), ("concentrated", pa.bool_()),
    ("emphasis", pa.list_(pa.struct([("tag", pa.string()), ("keyword", pa.string()), ("text", pa.string())]))),
    ("body_text", pa.string()), ("body_words", pa.int32()), ("semantic_text", pa.string()),
    ("paragraphs", pa.list_(pa.struct([("paragraph_id", pa.int32()), ("section", pa.string()), ("sentences", pa.list_(_SENTENCE)), ("word_count", pa.int32())]))),
    ("parse_error", pa.string()),
])
_CHUNK = "struct<chunk_id:int,text:string,start_word:int,end_word:int,word_count:int>"
_CHUNKS = f"array<{_CHUNK}>"
#: What a judgement without an encoder reads.
_COUNTS = ("keyword", "body", "introduction", "headings", "conclusion", "minor", "secondary", "long_tail", "distribution", "concentrated", "emphasis", "body_words", "paragraphs")


class _Pages:
    """The span tables of a share, as flat lists of their fields."""

    def __init__(self, pages: pa.StructArray):
        fields = lambda x: dict(zip((f.name for f in x.type), x.flatten(), strict=True))
        elements, pieces, sections = map(fields(pages).get, ("elements", "pieces", "sections"))
        # The offsets of a slice count from the start of the batch, its own values don't.
        self.at, self.pieces_at, self.sections_at = ([o - at[0] for o in at] for at in (x.offsets.to_pylist() for x in (elements, pieces, sections)))
        parts = fields(elements.flatten())
        self.tags, self.parents, self.firsts, self.ends = (parts[f].to_pylist() for f in ("tag", "parent", "first", "end"))
        self.pieces, self.sections, self.errors = pieces.flatten().to_pylist(), sections.flatten().to_pylist(), fields(pages)["error"].to_pylist()

    def page(self, i: int) -> _Page:
        own, pieces, sections = (slice(x[i], x[i + 1]) for x in (self.at, self.pieces_at, self.sections_at))
        return _Page(self.tags[own], self.parents[own], self.firsts[own], self.ends[own], self.pieces[pieces], self.sections[sections], self.errors[i])


class _Page:
    """One span table; its pieces are folded once, whatever elements they stand in."""

    def __init__(self, tags: list[str], parents: list[int], firsts: list[int], ends: list[int], pieces: list[str], sections: list[dict], error: str | None):
        self.tags, self.parents, self.firsts, self.ends = tags, parents, firsts, ends
        self.pieces, self.sections, self.error = pieces, sections, error
        self.folded = [matching.fold(p) for p in pieces]

    @classmethod
    def of(cls, content: str) -> _Page:
        found = html.tokenize(content)
        return cls(*([e[f] for e in found["elements"]] for f in ("tag", "parent", "first", "end")), found["pieces"], found["sections"], found["error"])

    def tag(self, pos: int) -> str:
        return self.tags[pos]

    def texts(self, positions: list[int]) -> tuple[str, str]:
        """The texts below elements, joined, as they are and folded."""
        spans = [slice(self.firsts[p], self.ends[p]) for p in positions]
        return " ".join(x for s in spans for x in self.pieces[s]), " ".join(x for s in spans for x in self.folded[s] if x)

    def named(self, *tags: str) -> list[int]:
        return [i for i, t in enumerate(self.tags) if t in tags]

    def introduction(self) -> tuple[str, str]:
        found = []
        for pos, parent in enumerate(self.parents):
            if parent == -1:
                if self.tag(pos) == "h2":
                    break
                if self.tag(pos) in rules.TEXT_BLOCKS:
                    found.append(pos)
        return self.texts(found)


def _sentences(zone: str, folded: str) -> list[tuple[str, str]]:
    """The sentences of a text, as they are and folded. White space is collapsed in both, so that no line ends in them."""
    cut, short = ([x for x in z.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n") if x] for z in (zone, folded))
    # A sentence of marks alone folds to nothing, which leaves fewer.
    return list(zip(cut, short if len(cut) == len(short) else map(matching.fold, cut), strict=True))


def _signals(page: _Page, main: str | None, secondary: list[str], long_tail: list[str], wanted: frozenset[str], spoken: bool) -> dict:
    """The wanted signals of a page; all keywords are found in a text together. Only with `spoken` paragraphs have their sentences."""
    if wanted <= {"emphasis"}:
        return {"emphasis": _emphasis(page, [k for k in (main, *secondary, *long_tail) if k is not None]), "parse_error": page.error}
    keyword = " ".join(unescape(main or "").split())
    minor = list(dict.fromkeys(k for k in (*secondary, *long_tail) if k is not None))
    every = [k for k in (main, *secondary, *long_tail) if k is not None]
    of_main, of_minor = (matching.matcher(tuple(map(matching.fold, k))).counts for k in ([keyword], minor))
    body, folded = " ".join(page.pieces), " ".join(x for x in page.folded if x)
    intro = page.introduction()
    sections = []
    for s in page.sections:
        (title, name), members = page.texts([s["pos"]]), s["members"]
        sections.append((title, name, page.texts(members), [m for m in members if page.tag(m) != "h3"]))
    explicit = [s for s in sections if s[1] == "conclusion"]
    kept = [s for s in sections if s[1] not in rules.COMPLEMENTARY_TITLES]
    end = page.texts((explicit[:1] or kept[-1:] or sections[-1:] or [("", "", "", [])])[0][3])
    useful = [s for s in sections if s[1] not in rules.UTILITY_TITLES]
    counted = [{"keyword": k, "n": n} for k, n in zip(minor, of_minor(folded), strict=True)] if wanted & {"minor", "secondary", "long_tail"} else []
    spread = []
    if wanted & {"distribution", "concentrated"}:
        spread = [{"h2": title, "matched": [k for k, n in zip(minor, of_minor(whole[1]), strict=True) if n]} for title, _, whole, _ in useful]
    marked = _emphasis(page, every) if "emphasis" in wanted else []
    filled = [(title, whole) for title, _, whole, _ in useful if whole[0]]
    paragraphs = []
    for i, (name, zone) in enumerate(([("introduction", intro)] * bool(intro[0]) + filled) * ("paragraphs" in wanted), 1):
        sentences = [{"sentence_id": j, "text": x, "exact": of_main(short)[0] > 0} for j, (x, short) in enumerate(_sentences(*zone), 1)] if spoken else []
        paragraphs.append({"paragraph_id": i, "section": name, "sentences": sentences, "word_count": zone[0].count(" ") + 1})
    semantic = " ".join([intro[0]] * bool(intro[0]) + [f"{title}. {whole[0]}" if title else whole[0] for title, whole in filled])
    return {
        "keyword": keyword, "body": of_main(folded)[0], "introduction": of_main(intro[1])[0], "headings": sum(of_main(page.texts([p])[1])[0] for p in page.named("h2", "h3")), "conclusion": of_main(end[1])[0],
        "minor": counted, "secondary": [c for c in counted if c["keyword"] in secondary], "long_tail": [c for c in counted if c["keyword"] in long_tail],
        "distribution": spread, "concentrated": sum(bool(s["matched"]) for s in spread) == 1 and len(spread) > 1, "emphasis": marked,
        "body_text": body, "body_words": body.count(" ") + 1 if body else 0, "semantic_text": semantic or body, "paragraphs": paragraphs, "parse_error": page.error,
    }


def _emphasis(page: _Page, keywords: list[str]) -> list[dict]:
    counts = matching.matcher(tuple(map(matching.fold, keywords))).counts
    marked = []
    for tag in rules.EMPHASIS_TAGS:
        for pos in page.named(tag):
            shown, short = page.texts([pos])
            marked += [{"tag": tag, "keyword": k, "text": shown} for k, n in zip(keywords, counts(short), strict=True) if n]
    return marked


def _finder(signals: tuple[str, ...], spoken: bool, parsed: bool) -> Callable[..., Column]:
    """A UDF of page (a span table if `parsed`, else a content), main keyword, secondary and long-tail keywords for the signals named."""
    kind, wanted = pa.struct([f for f in _LEXICAL if f.name in (*signals, "parse_error")]), frozenset(signals)

    def found(pages: pa.Array, *keywords: pa.Array) -> pa.Array:
        # The span tables of contents needn't leave the worker.
        read = map(_Pages(pages).page, range(len(pages))) if parsed else (_Page.of(c or "") for c in pages.to_pylist())
        rows = zip(read, *(k.to_pylist() for k in keywords), strict=True)
        return pa.array([_signals(page, main, secondary or [], long_tail or [], wanted, spoken) for page, main, secondary, long_tail in rows], kind)

    @F.arrow_udf(from_arrow_type(kind))
    def run(rows: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return shares.served(found, rows)

    # Its fields are read in many places; it must not be computed for each of them.
    return run.asNondeterministic()


def lexical(df: DataFrame, content: str = "content", page: str | None = None, signals: tuple[str, ...] = tuple(f.name for f in _LEXICAL), spoken: bool = True) -> DataFrame:
    """df (content, main_keyword, secondary_keywords, long_tail_keywords) -> also the keyword signals as columns `lexical_...`.

    `page` names a column that holds the parsed content already. Null keywords and lists are empty ones. `signals` names those
    that are wanted (an error of the parser comes with any), as none of a Python function's fields is left out for not being
    read; without `spoken`, paragraphs have no sentences.
    """
    none = F.array().cast("array<string>")
    keywords = F.col("main_keyword"), F.coalesce("secondary_keywords", none), F.coalesce("long_tail_keywords", none)
    source = F.col(content)
    if page:
        # Only what the matcher reads goes to it.
        at = F.col(page)
        elements = F.transform(at["elements"], lambda e: F.struct(e["tag"].alias("tag"), e["parent"].alias("parent"), e["first"].alias("first"), e["end"].alias("end")))
        source = F.struct(at["pieces"].alias("pieces"), elements.alias("elements"), at["sections"].alias("sections"), at["error"].alias("error"))
    df = df.withColumn("_found", _finder(signals, spoken, page is not None)(source, *keywords))
    return df.withColumns({f"lexical_{f.name}": F.col(f"_found.{f.name}") for f in _LEXICAL if f.name in (*signals, "parse_error")}).drop("_found")


class _Lexical:
    """The columns that lexical() added, by name."""

    def __getitem__(self, name: str) -> Column:
        return F.col(f"lexical_{name}")


def _band(x: Column, limits: tuple, values: tuple) -> Column:
    out = F.when(x <= limits[0], values[0])
    for limit, value in zip(limits[1:], values[1:], strict=False):
        out = out.when(x <= limit, value)
    return out.otherwise(values[-1])


def overoptimization(matches: Column, words: Column, only_near: Column | None = None) -> Column:
    """Density, concentration, repetition and risk from the number of matching sentences of each paragraph; `only_near` is how many match by meaning alone."""
    total = F.aggregate(matches, F.lit(0), lambda s, n: s + n)
    density = F.bround(total / words, 4)
    d = F.when(words <= 0, 100).otherwise(_band(total / words, (0.025, 0.045, 0.065), (100, 75, 45, 20)))
    ratio = F.when(total <= 0, 1.0).otherwise(F.size(F.filter(matches, lambda n: n > 0)) / total)
    c = F.when(total <= 0, 100).when(ratio >= 0.75, 100).when(ratio >= 0.5, 75).when(ratio >= 0.25, 45).otherwise(20)
    most = F.coalesce(F.array_max(matches), F.lit(0))
    r = _band(most, (1, 2, 3), (100, 75, 45, 20))
    score = F.when(total == 0, 100).otherwise(F.bround(0.40 * d + 0.35 * c + 0.25 * r).cast("int"))
    risk = F.when(total == 0, "not_applicable").when(score >= 85, "low").when(score >= 70, "medium_low").when(score >= 50, "medium_high").otherwise("high")
    level = lambda score: F.element_at(F.create_map(*map(F.lit, (100, "low", 75, "medium", 45, "high", 20, "very_high"))), score)
    return F.struct(
        total.alias("occurrences"), F.when(words > 0, density).otherwise(0.0).alias("density"), F.when(words <= 0, "none").otherwise(level(d)).alias("density_level"), d.alias("density_score"),
        F.size(F.filter(matches, lambda n: n > 0)).alias("paragraphs_with_matches"), F.bround(ratio, 4).alias("concentration_ratio"), F.when(total <= 0, "none").otherwise(level(c)).alias("concentration_level"), c.alias("concentration_score"),
        most.alias("max_local_repetition"), level(r).alias("local_repetition_level"), r.alias("local_score"), score.alias("score"), risk.alias("risk"), (total > 0).alias("applicable"), F.coalesce(F.lit(0) if only_near is None else only_near, F.lit(0)).alias("only_near"),
    )


def resolution_error() -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(blank("content_type"), "missing_content_type")
        .when(blank("expected_length"), "missing_expected_length")
        .when(~F.col("expected_length").isin(*rules.EXPECTED_LENGTHS), "unsupported_expected_length")
        .when(blank("funnel_stage"), "missing_funnel_stage")
        .when(~F.col("funnel_stage").isin(*rules.FUNNEL_STAGES), "unsupported_funnel_stage")
        .when(blank("main_keyword"), "missing_main_keyword")
    )


def judge(
    df: DataFrame,
    encoder: Encoder | services.Encoder | services.VectorTable | None = None,
    column: str = "seo",
    page: str | None = None,
    chunk_words: int = rules.CHUNK_WORDS,
    chunk_overlap: int = rules.CHUNK_OVERLAP,
    top_chunks: int = rules.TOP_CHUNKS,
    settings: str | None = None,
) -> DataFrame:
    """df (content, content_type, expected_length, funnel_stage, main_keyword, secondary_keywords, long_tail_keywords)
    -> also `seo`: status, score, findings, error; `seo_scores`, its parts; and `seo_signals`, what they rest on.

    A table-wide encoder (see services) encodes each distinct text of all rows once: keywords, chunks and sentences; a
    column function is called once for each row. Without an encoder, or where one of a row's texts has no vector, nothing
    semantic is available there: the semantic score is 0 and over-optimisation not applicable. `settings` names a map column
    of rules that change severities, switches, numbers of occurrences and the scores that pass.
    """
    rule = Settings(settings)
    simple = (F.col("funnel_stage") == "AWARENESS") & (F.col("expected_length") == "SIMPLE")
    own = df.withColumn("_long", F.col("long_tail_keywords")).withColumn("long_tail_keywords", F.when(simple, F.array().cast("array<string>")).otherwise(F.col("long_tail_keywords")))
    own = lexical(own, page=page, **{"signals": _COUNTS, "spoken": False} if encoder is None else {})
    lex = _Lexical()
    own = own.withColumn("_paragraphs", lex["paragraphs"])
    sentences = F.flatten(F.transform("_paragraphs", lambda p: F.transform(p["sentences"], lambda s: F.struct(p["paragraph_id"].alias("p"), s["text"].alias("text"), s["exact"].alias("exact")))))
    # Chunks and sentences are there for an encoder alone.
    chunks = F.array().cast(_CHUNKS) if encoder is None else text.chunks(lex["semantic_text"], chunk_words, chunk_overlap)
    own = own.withColumns({"_sentences": sentences, "_chunks": chunks})
    wide = isinstance(encoder, (services.Encoder, services.VectorTable))
    if wide:
        # Texts are written once, as they are asked for; their places remain in the arrays beside them.
        lean = {"_sentences": F.transform("_sentences", lambda s: s.dropFields("text")), "_chunks": F.transform("_chunks", lambda c: c.dropFields("text")), "_paragraphs": F.transform("_paragraphs", lambda p: p.dropFields("sentences"))}
    none = F.lit(None).cast("array<array<double>>")
    if encoder is not None:
        asked = F.concat(F.array(lex["keyword"]), F.transform("_chunks", lambda c: c["text"]), F.transform("_sentences", lambda s: s["text"]))
        # An array of one, taken apart again: the optimizer leaves that where it is, so the encoder gets a plain column.
        own = own.withColumn("_asked", F.explode(F.array(asked)))
    # The keyword's closeness to each chunk, then to each sentence.
    if wide:
        own = services.closeness(own.withColumns(lean).drop("lexical_paragraphs", "lexical_body_text", "lexical_semantic_text"), "_asked", encoder, cosine, "_near", "_unavailable")
        chunk = lambda c: F.struct(c["chunk_id"], F.get("_asked", c["chunk_id"]).alias("text"), c["start_word"], c["end_word"], c["word_count"])
        own = own.withColumn("_chunks", F.transform("_chunks", chunk).cast(_CHUNKS))
    else:
        own = own.withColumns({"_vectors": none if encoder is None else encoder(F.col("_asked")), "_unavailable": F.lit(None).cast("string")})
        own = own.withColumn("_near", F.transform(F.slice("_vectors", F.lit(2), F.greatest(F.size("_vectors") - 1, F.lit(0))), lambda v: cosine(F.get("_vectors", F.lit(0)), v)))
    ranked = F.zip_with("_chunks", F.slice("_near", F.lit(1), F.size("_chunks")), lambda c, s: F.struct(s.alias("similarity"), (-c["chunk_id"]).alias("later"), c.alias("chunk")))
    best = F.transform(F.slice(F.sort_array(ranked, False), 1, top_chunks), lambda x: F.struct(x["chunk"].alias("chunk"), x["similarity"].alias("similarity")))
    spoken = F.slice("_near", F.size("_chunks") + 1, F.size("_sentences"))
    hits = F.zip_with("_sentences", spoken, lambda e, s: F.struct(e["p"].alias("p"), s.alias("similarity"), (e["exact"] | (s >= rules.SENTENCE_SIMILARITY)).alias("hit"), (~e["exact"] & (s >= rules.SENTENCE_SIMILARITY)).alias("only_near")))
    # Without chunks or sentences there is nothing to ask for, so nothing that is unavailable.
    own = own.withColumns({
        "_available": F.col("_near").isNotNull() | (lex["body_words"] == 0), "_spoken": F.col("_near").isNotNull() | (F.size("_paragraphs") == 0),
        "_top": F.coalesce(best, F.array().cast(f"array<struct<chunk:{_CHUNK},similarity:double>>")), "_hits": hits,
    })
    own = own.withColumns({
        "_similar": F.transform("_top", lambda x: x["similarity"]),
        "_matches": F.transform("_paragraphs", lambda p: F.coalesce(F.size(F.filter("_hits", lambda h: (h["p"] == p["paragraph_id"]) & h["hit"])), F.lit(0))),
    })
    own = own.withColumn("_matches", F.when(F.col("_hits").isNull(), F.transform("_paragraphs", lambda p: F.lit(0))).otherwise(F.col("_matches")))
    total = F.aggregate("_paragraphs", F.lit(0), lambda s, p: s + p["word_count"])
    own = own.withColumn("_words", F.coalesce(F.nullif(total, F.lit(0)), lex["body_words"]))
    own = own.withColumn("_over", overoptimization(F.col("_matches"), F.col("_words"), F.size(F.filter("_hits", lambda h: h["only_near"]))))
    over, n = F.col("_over"), lex["body"]
    semantic = weighted_score(F.col("_similar"))
    own = own.withColumn("_semantic", F.when(n == 0, F.least(semantic, F.lit(40))).otherwise(F.least(F.greatest(semantic, F.lit(0)), F.lit(100))))
    reduction = F.when(n == 0, 0).when(semantic >= 75, 10).when(semantic >= 60, 5).otherwise(0)
    quiz = F.col("content_type") == "quiz"
    kind = F.when(quiz, "quiz").otherwise(F.col("expected_length"))
    fixed = lambda i: F.when(quiz, F.lit(rules.QUIZ_OCCURRENCES[i]).cast("int")).otherwise(F.coalesce(*(F.when(F.col("expected_length") == k, F.lit(v[i]).cast("int")) for k, v in rules.OCCURRENCES.items())))
    bound = lambda i: rule.limit(F.concat(F.lit("seo.occurrences."), kind, F.lit((".min", ".max", ".main_min")[i])), fixed(i))
    below = F.coalesce(n < bound(0), F.lit(False)) | F.coalesce(n < bound(2), F.lit(False))
    above = F.coalesce(n > bound(1), F.lit(False))
    missing = F.filter(F.array(
        F.when(lex["introduction"] == 0, "introduction"), F.when(~quiz & (lex["headings"] == 0), "heading_h2_or_h3"), F.when(~quiz & (lex["conclusion"] == 0), "conclusion"), F.when(n == 0, "body"),
    ), lambda x: x.isNotNull())
    gaps = F.when(F.size(lex["minor"]) > 0, F.transform(F.filter(lex["distribution"], lambda s: F.size(s["matched"]) == 0), lambda s: s["h2"])).otherwise(F.array().cast("array<string>"))
    uneven = (F.size(gaps) > 0) | lex["concentrated"]
    emphasis = (F.size(lex["emphasis"]) > 0) & ~quiz
    f = text.finding
    checks = (
        (n == 0, f("seo.main_keyword_presence", rule.severity("seo.main_keyword_presence"), "The main keyword doesn't stand in the text.", keyword=F.col("main_keyword")), F.lit(25)),
        (F.size(missing) > 0, f("seo.main_keyword_locations", rule.severity("seo.main_keyword_locations"), "The main keyword is missing where it is required.", locations=missing), F.lit(20)),
        (below | above, f("seo.keyword_occurrences", rule.severity("seo.keyword_occurrences", F.when((reduction > 0) & ~above, "minor").otherwise("major")), "The main keyword occurs too rarely or too often.", occurrences=n, least=bound(0), most=bound(1)), F.greatest(15 - reduction, F.lit(5))),
        (uneven, f("seo.keyword_distribution", rule.severity("seo.keyword_distribution"), "Keywords are spread unevenly over the sections.", concentrated=lex["concentrated"], sections=gaps), F.greatest(8 - reduction, F.lit(0))),
        (over["risk"].isin("medium_high", "high"), f("seo.over_optimization", rule.severity("seo.over_optimization"), "The text repeats the keyword too much.", risk=over["risk"], score=over["score"]), F.when(over["risk"] == "high", 20).otherwise(10)),
        (emphasis, f("seo.formatting_constraints", rule.severity("seo.formatting_constraints"), "Keywords are emphasised.", count=F.size(lex["emphasis"])), F.lit(10)),
    )
    checks = tuple((c & rule.enabled(f"seo.{name}"), x, p) for name, (c, x, p) in zip(RULES["seo"], checks, strict=True))
    unavailable = (
        (~F.col("_available"), f("seo.semantic_unavailable", "minor", "Semantic closeness could not be measured.", error=F.col("_unavailable"))),
        (~F.col("_spoken"), f("seo.overoptimization_semantic_unavailable", "minor", "Semantic over-optimisation could not be measured.", error=F.col("_unavailable"))),
    )
    own = own.withColumn("_judged", text.findings(*((c, x) for c, x, _ in checks)))
    penalty = sum((F.when(c, p).otherwise(0) for c, _, p in checks), F.lit(0))
    own = own.withColumn("_lexical", F.greatest(100 - penalty, F.lit(0)))
    with_over = F.bround(0.55 * F.col("_lexical") + 0.30 * F.col("_semantic") + 0.15 * over["score"])
    score = F.when(over["risk"] == "not_applicable", F.bround(0.65 * F.col("_lexical") + 0.35 * F.col("_semantic"))).otherwise(with_over).cast("int")
    own = own.withColumn("_score", score)
    error = F.coalesce(resolution_error(), lex["parse_error"])
    ok = error.isNull()
    status = F.when(n == 0, "fail").when((F.col("_score") >= rule.number("seo.pass_score")) & (F.size("_judged") == 0), "pass").when(F.col("_score") >= rule.number("seo.warn_score"), "warn").otherwise("fail")
    result = F.struct(
        F.when(ok, status).alias("status"), F.when(ok, F.col("_score")).alias("score"),
        F.when(ok, F.concat(text.findings(*unavailable), F.col("_judged"))).otherwise(F.array().cast(f"array<{text.FINDING}>")).alias("findings"),
        error.alias("error"),
    )
    hidden = [c for c in own.columns if c not in (*df.columns, "_long")]
    parts = F.when(ok, F.struct(F.col("_lexical").alias("lexical"), F.col("_semantic").alias("semantic"), over["score"].alias("overoptimization"), over["risk"].alias("overoptimization_risk"), over["applicable"].alias("overoptimization_applicable")))
    level = F.when(reduction == 10, "strong").when(reduction == 5, "medium").otherwise("none")
    signals = F.when(ok, F.struct(
        F.struct(F.col("main_keyword"), F.col("_top").alias("top_chunks"), F.coalesce(F.get("_similar", F.lit(0)), F.lit(0.0)).alias("best_similarity"), semantic.alias("semantic_score"), F.col("_available").alias("available")).alias("semantic"),
        F.struct(level.alias("level"), reduction.alias("penalty_reduction"), (reduction > 0).alias("compensated")).alias("compensation"),
        over.alias("overoptimization"), lex["secondary"].alias("secondary_occurrences"), lex["long_tail"].alias("long_tail_occurrences"),
    ))
    return own.withColumns({column: result, f"{column}_scores": parts, f"{column}_signals": signals}).drop(*hidden, "long_tail_keywords").withColumnRenamed("_long", "long_tail_keywords")
