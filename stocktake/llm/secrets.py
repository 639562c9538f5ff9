"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions only.

Positions come from a marking replacement: every match is framed by U+0001 and the text is split
there, so matches are the pieces at odd places and their starts are running sums of lengths in
code points, taken in blocks of pieces so that work does not grow with the square of the matches.
(U+0001 in a text is read as U+0002 first; neither belongs to any pattern.)

Besides the base kinds, ``generic`` candidates (runs of 24 or more token characters with a digit
and both cases) are judged by how the corpus uses them: hashes of all candidates are aggregated
to distinct repositories and owners. What more than ``max_owners`` owners hold in more than
``max_repos`` repositories is a widely copied example and no finding; anything rarer, however
often its one owner repeats it, looks live and is reported. Base spans stay whatever their verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stocktake.llm.shared import written

#: Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
GENERIC = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "generic")
MARK = "\u0001"
SPAN = "struct<start:bigint,rank:int,end:bigint,value:string>"
#: Pieces whose spans are gathered together; an even number, so that every block begins outside a match.
PIECES = 256
#: A hash with at least one in HOT_ONE_IN of all uses is joined by broadcast (there are at most HOT_ONE_IN of them), the others by key.
HOT_ONE_IN = 1000


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _found(text: Column, pattern: str, rank: int, value, keep) -> Column:
    """array<SPAN> of one kind. value, keep: from the matched piece."""
    none = F.array().cast(f"array<{SPAN}>")

    def spans(at: Column, block: Column) -> Column:
        def step(acc: Column, piece: Column) -> Column:
            end = acc["at"] + F.length(piece)
            span = F.struct(acc["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), value(piece).alias("value"))
            more = F.when(acc["match"] & keep(piece), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
            return F.struct(end.alias("at"), (~acc["match"]).alias("match"), more.alias("spans"))

        start = F.struct(at.alias("at"), F.lit(False).alias("match"), none.alias("spans"))
        return F.aggregate(block, start, step, lambda acc: acc["spans"])

    def cut(pieces: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / PIECES).cast("int")), lambda b: F.slice(pieces, b * PIECES + 1, F.lit(PIECES)))
        return F.when(F.size(pieces) > 1, _let(blocks, located)).otherwise(none)

    def located(blocks: Column) -> Column:
        length = lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda n, piece: n + F.length(piece))
        ends = F.aggregate(blocks, F.array(F.lit(0).cast("bigint")), lambda ends, block: F.concat(ends, F.array(F.element_at(ends, -1) + length(block))))
        return F.flatten(F.zip_with(F.slice(ends, 1, F.size(blocks)), blocks, spans))

    return _let(F.split(F.regexp_replace(F.translate(text, MARK, "\u0002"), F.lit(pattern), F.lit(MARK + "$0" + MARK)), MARK, -1), cut)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, by start and then kind."""
    whole = lambda piece: piece
    secret = lambda piece: F.regexp_extract(piece, ASSIGN, 2)
    always = lambda piece: F.lit(True)
    return F.array_sort(F.concat(
        _found(text, ASSIGN, 0, secret, lambda piece: F.length(secret(piece)) >= 12),
        _found(text, ACCESS, 1, whole, always), _found(text, HEX, 2, whole, always)))


def generic_spans(text: Column) -> Column:
    """Candidates of the generic kind."""
    return _found(text, GENERIC, 3, lambda piece: piece, lambda piece: piece.rlike("[0-9]") & piece.rlike("[A-Z]") & piece.rlike("[a-z]"))


def ownership(found: DataFrame, owner_col: str, repo_col: str) -> DataFrame:
    """(hash, n_owners, n_repos, n_uses) of every candidate; counted in steps, so that no task gathers a common one."""
    each = found.select(F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), F.explode(F.concat("_base", "_generic")).alias("span")).select(F.sha2("span.value", 256).alias("hash"), "owner", "repo")
    in_repo = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    in_owner = in_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return in_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_uses"))


def _scanned(docs: DataFrame, keep: list[str], text_col: str, owner_col: str, repo_col: str, max_owners: int, max_repos: int) -> tuple[DataFrame, DataFrame]:
    """The scan, done once: (found: columns k0, k1, ... for ``keep``, _row, _base, _generic; judged: _row with
    _spans, n_live, n_copied, most_owners, most_repos of the rows that have candidates)."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"), F.col(owner_col).alias("_owner"), F.col(repo_col).alias("_repo"))
    scanned = source.withColumn("_base", base_spans(text)).withColumn("_generic", generic_spans(text))
    apart = F.expr("filter(_generic, g -> NOT exists(_base, b -> b.start < g.end AND g.start < b.end))")
    found = written(scanned.withColumn("_generic", apart).drop("_text").withColumn("_row", F.monotonically_increasing_id()), "secrets")
    any_found = found.filter("size(_base) + size(_generic) > 0").select("_row", "_owner", "_repo", "_base", "_generic")
    verdict = written(ownership(any_found, "_owner", "_repo").withColumn("copied", (F.col("n_owners") > max_owners) & (F.col("n_repos") > max_repos)), "ownership")
    total = verdict.agg(F.coalesce(F.sum("n_uses"), F.lit(0))).first()[0]
    hot = (F.col("n_uses") >= max(1000, -(-total // HOT_ONE_IN))).alias("hot")
    own = verdict.select("hash", "n_owners", "n_repos", "copied", hot)
    each = any_found.select("_row", F.explode(F.concat("_base", "_generic")).alias("span")).withColumn("hash", F.sha2("span.value", 256))
    common = own.filter("hot").drop("hot")
    often = each.join(F.broadcast(common), "hash")
    rest = each.join(F.broadcast(common.select("hash")), "hash", "left_anti").join(own.filter("NOT hot").drop("hot").hint("merge"), "hash")
    judged = often.unionByName(rest).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when((F.col("span.rank") < 3) | ~F.col("copied"), F.col("span")))).alias("_spans"),
        F.count_if(~F.col("copied")).alias("n_live"), F.count_if("copied").alias("n_copied"), F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"))
    return found, judged


def scan_secrets(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", max_owners: int = 1, max_repos: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, doc_id by default) with their spans.

    _base: array<SPAN> of the base kinds; _spans: base and accepted generic ones by start, then
    kind; n_live, n_copied: candidates that are not, or are, widely copied; most_owners,
    most_repos: of the candidate with most of them (0 without candidates). A repository is one
    owner's ``repo_col``. Null and empty texts have no spans; null owners and repositories count
    as one of their own; equal rows give equal results; an empty table an empty one; names of
    other columns of ``docs`` do not matter.
    """
    keep = keep or ["doc_id"]
    found, judged = _scanned(docs, keep, text_col, owner_col, repo_col, max_owners, max_repos)
    out = found.join(judged.hint("merge"), "_row", "left")
    count = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "_base", F.coalesce("_spans", F.array().cast(f"array<{SPAN}>")).alias("_spans"),
                      *map(count, ("n_live", "n_copied", "most_owners", "most_repos")))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", max_owners: int = 1, max_repos: int = 2) -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark`` (overlapping spans by one) and n_chars, if there is one, recounted.

    The texts are scanned once; documents without a candidate pass untouched and unshuffled. Null
    and empty texts, equal rows, empty tables and clashing names as in ``scan_secrets``.
    """
    names = docs.columns
    found, judged = _scanned(docs, names, text_col, owner_col, repo_col, max_owners, max_repos)
    own = [f"k{i}" for i in range(len(names))]
    text, chars = own[names.index(text_col)], own[names.index("n_chars")] if "n_chars" in names else None
    clean = found.filter("size(_base) + size(_generic) = 0").select(*own)
    hit = found.filter("size(_base) + size(_generic) > 0").select("_row", *own).join(judged.select("_row", "_spans").hint("merge"), "_row")
    merged = F.expr("""aggregate(_spans, cast(array() as array<struct<s:bigint,e:bigint>>), (a, x) ->
        CASE WHEN size(a) > 0 AND x.start < element_at(a, -1).e
             THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s as s, greatest(element_at(a, -1).e, x.end) as e)))
             ELSE concat(a, array(struct(x.start as s, x.end as e))) END)""")
    pieces = F.expr(f"""transform(sequence(0, size(_m)), i -> substring({text},
        cast(if(i = 0, 0, element_at(_m, greatest(i, 1)).e) + 1 as int),
        cast(if(i = size(_m), length({text}), element_at(_m, least(i + 1, size(_m))).s) - if(i = 0, 0, element_at(_m, greatest(i, 1)).e) as int)))""")
    fixed = hit.withColumn("_m", merged).withColumn(text, F.when(F.size("_m") > 0, F.array_join(pieces, mark)).otherwise(F.col(text)))
    if chars:
        fixed = fixed.withColumn(chars, F.when(F.size("_m") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(chars)))
    return clean.unionByName(fixed.select(*own)).toDF(*names)
