"""Checks of generated notes: each returns rows (video_id, rule, ord, detail); no row means that all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext import model
from chronotext.functions import scalars as S

#: Patterns of cue anchors, deep links and slide images in notes.
CUE_ANCHOR = r'<a\s+id="(t\d{6}(?:-\d+)?)"></a>'
DEEP_LINK = r"https://youtu\.be/[^\s)]+\?t=(\d+)"
SLIDE_IMAGE = r"(?i)(?:!\[[^\]]*\]\([^)]*frames/[^)]*\))|(?:<img[^>]*frames/[^>]*>)"


def bullets(block: Column) -> Column:
    """The lines of a block, whose line breaks are `\\n`, that begin a bullet."""
    return F.filter(F.split(block, "\n", -1), lambda x: F.startswith(x, F.lit("- ")))


def _cue_list(transcript: Column) -> Column:
    """Seconds of all cue anchors of a transcript, in order, each once."""
    ids = F.regexp_extract_all(F.coalesce(transcript, F.lit("")), F.lit(CUE_ANCHOR), 1)
    return F.array_distinct(F.transform(ids, S.anchor_seconds))


def cue_seconds(transcripts: DataFrame) -> DataFrame:
    """(video_id, sec) of all cue anchors in transcripts (video_id, transcript)."""
    return transcripts.select("video_id", F.explode(_cue_list(F.col("transcript"))).alias("sec")).distinct()


def _problem(rule: Column, ord_: Column, detail: Column) -> Column:
    return F.struct(rule.alias("rule"), ord_.cast("int").alias("ord"), detail.cast("string").alias("detail"))


def _where(found: list[tuple[Column, str, int, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, _problem(F.lit(rule), F.lit(n), detail)) for cond, rule, n, detail in found]))


def _structure(contract: model.Contract) -> Column:
    places = [F.col(f"_at{n}") for n in range(len(contract.anchors))]
    found = [(F.substring_index("_text", "\n", 1) != contract.marker, "marker", 0, F.lit(contract.marker))]
    for n, (anchor, place) in enumerate(zip(contract.anchors, places, strict=True)):
        found.append((place == 0, "missing_section", n + 1, F.lit(anchor)))
        if n:
            before = places[0] if n == 1 else F.greatest(*places[:n])
            found.append(((place > 0) & (place < before), "section_order", n + 1, F.lit(anchor)))
    return _where(found)


def _enrichment(text: Column, takeaway: Column, flow: Column, contract: model.Contract) -> Column:
    take, steps = F.size(bullets(takeaway)), F.size(bullets(flow))
    left = F.contains(text, F.lit(contract.open_marker))
    return _where([(left, "open_marker", 0, F.lit(contract.open_marker)), (take != 3, "takeaways", 1, take), (steps < 2, "flow", 2, steps)])


def _detail(block: Column, has_frames: Column, contract: model.Contract) -> Column:
    # A part begins with what follows `### ` on a heading's line; what is before the first heading isn't one.
    parts = F.split(F.concat(F.lit("\n"), block), "\n### ", -1)
    own = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def of_part(part: Column, no: Column) -> Column:
        lines = F.split(part, "\n", -1)
        heading, body = F.concat(F.lit("### "), F.get(lines, F.lit(0))), F.slice(lines, F.lit(2), F.size(lines))
        no_bullet = ~F.exists(body, lambda x: F.startswith(x, F.lit("- ")))
        no_image = F.coalesce(has_frames, F.lit(False)) & ~F.contains(part, F.lit(contract.intro_marker)) & ~F.exists(body, lambda x: x.rlike(SLIDE_IMAGE))
        problem = lambda rule: _problem(F.lit(rule), no + 1, heading)
        return F.array(F.when(no_bullet, problem("slide_bullet")), F.when(no_image, problem("slide_image")))

    return F.array_compact(F.flatten(F.transform(own, of_part)))


def _citations(concepts: Column, questions: Column, cues: Column) -> Column:
    cited = F.filter(F.split(questions, "\n", -1), lambda x: F.contains(x, F.lit("youtu.be/")))

    def of_line(kind: str):
        def check(line: Column, at: Column) -> Column:
            digits = F.regexp_extract(line, DEEP_LINK, 1)
            sec = digits.try_cast("bigint")
            # A number beyond all seconds is a link that is off, too.
            near = F.coalesce(F.exists(cues, lambda c: F.abs(c - sec) <= 1), F.lit(False))
            off = F.when((F.size(cues) > 0) & ~near, _problem(F.lit(f"{kind}_link_off"), at, F.coalesce(sec.cast("string"), digits)))
            return F.when(digits == "", _problem(F.lit(f"{kind}_link_missing"), at, line)).otherwise(off)

        return check

    each = F.concat(F.transform(bullets(concepts), of_line("concept")), F.transform(cited, of_line("question")))
    return F.concat(F.array_compact(each), _where([(F.size(cited) < 3, "few_cited_questions", 0, F.size(cited))]))


def _cut(notes: DataFrame, contract: model.Contract, **sections: str) -> DataFrame:
    """The notes with their text (`_text`, line breaks as `\\n`), the first place of each anchor (`_at0` ...) and the blocks of
    sections: from an anchor's first place to the first later anchor, in contract order, that follows it; else to the end.

    What several expressions need is a column before them, so that it is taken once a row."""
    names = list(contract.anchors)
    rows = notes.withColumn("_text", F.regexp_replace(F.coalesce("notes", F.lit("")), r"\R", "\n"))
    rows = rows.withColumns({f"_at{n}": F.instr("_text", a) for n, a in enumerate(names)})
    at = {k: F.col(f"_at{names.index(a)}") for k, a in sections.items()}
    rows = rows.withColumns({f"_{k}_rest": F.when(at[k] > 0, F.substr("_text", at[k] + len(a))) for k, a in sections.items()})

    def stop(k: str, anchor: str) -> Column:
        return F.coalesce(*[F.nullif(F.instr(f"_{k}_rest", a), F.lit(0)) for a in names[names.index(anchor) + 1 :]], F.length(f"_{k}_rest") + 1)

    rows = rows.withColumns({f"_{k}_stop": stop(k, a) for k, a in sections.items()})
    blocks = {f"_{k}": F.coalesce(F.concat(F.lit(a), F.substr(f"_{k}_rest", F.lit(1), F.col(f"_{k}_stop") - 1)), F.lit("")) for k, a in sections.items()}
    return rows.withColumns(blocks)


def _exploded(rows: DataFrame, problems: Column) -> DataFrame:
    return rows.select("video_id", F.explode(problems).alias("p")).select("video_id", "p.rule", "p.ord", "p.detail")


def structure_problems(notes: DataFrame, contract: model.Contract = model.CONTRACT) -> DataFrame:
    """The marker on line 1, and every section anchor, in order."""
    return _exploded(_cut(notes, contract), _structure(contract))


def enrichment_problems(notes: DataFrame, contract: model.Contract = model.CONTRACT) -> DataFrame:
    """No placeholder marker is left; three takeaways; two bullets of flow at least."""
    rows = _cut(notes, contract, takeaway=contract.takeaway, flow=contract.flow)
    return _exploded(rows, _enrichment(F.col("_text"), F.col("_takeaway"), F.col("_flow"), contract))


def detail_problems(notes: DataFrame, contract: model.Contract = model.CONTRACT) -> DataFrame:
    """Every heading of the detail section has a bullet and, where the video has frames, an image of them; the intro needs
    none. Input: (video_id, notes, has_frames)."""
    rows = _cut(notes, contract, detail=contract.detail)
    return _exploded(rows, _detail(F.col("_detail"), F.col("has_frames"), contract))


def citation_problems(notes: DataFrame, transcripts: DataFrame, contract: model.Contract = model.CONTRACT) -> DataFrame:
    """Deep links of concept bullets and answers point at a cue, one second more or less; three answers have one. A video
    without cues has no link that is off."""
    own = transcripts.select("video_id", _cue_list(F.col("transcript")).alias("_c")).groupBy("video_id").agg(F.flatten(F.collect_list("_c")).alias("_cues"))
    rows = _cut(notes.join(own, "video_id", "left"), contract, concepts=contract.concepts, questions=contract.questions)
    return _exploded(rows, _citations(F.col("_concepts"), F.col("_questions"), F.coalesce("_cues", F.array().cast("array<int>"))))


def coverage_contract(notes: DataFrame, contract: model.Contract = model.CONTRACT) -> DataFrame:
    """The first layer, which a fresh skeleton fulfils: structure only."""
    return structure_problems(notes, contract)


def gate_contract(notes: DataFrame, contract: model.Contract = model.CONTRACT) -> DataFrame:
    """The second layer, for finished notes (video_id, notes, transcript, has_frames): all rules, in one pass without a
    shuffle: a row has all that its rules need."""
    rows = _cut(notes, contract, takeaway=contract.takeaway, flow=contract.flow, detail=contract.detail, concepts=contract.concepts, questions=contract.questions)
    rows = rows.withColumn("_cues", _cue_list(F.col("transcript")))
    found = [
        _structure(contract), _citations(F.col("_concepts"), F.col("_questions"), F.col("_cues")), _detail(F.col("_detail"), F.col("has_frames"), contract),
        _enrichment(F.col("_text"), F.col("_takeaway"), F.col("_flow"), contract),
    ]
    return _exploded(rows, F.concat(*found))
