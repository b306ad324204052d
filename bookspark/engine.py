"""The public surface: read books, check them, lay metadata over, fit them to a profile, write and report."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookspark.functions import paths
from bookspark.functions import text as tx
from bookspark.operators import filters, lint, merge, pages, transforms
from bookspark.session import checkpointed, ship
from bookspark.sinks import package
from bookspark.sources import archive, charset, css, html, images, profiles, raster

#: Codes of what can go wrong with a book, fixed values.
ERROR_CODES = ("archive", "drm", "zip64", "container", "package", "document", "wellformed", "output", "io")


@dataclass(frozen=True)
class Books:
    """The tables of a set of books. All are lazy."""

    entries: DataFrame
    manifest: DataFrame
    spine: DataFrame
    toc: DataFrame
    metadata: DataFrame
    errors: DataFrame
    raw: DataFrame
    facts: DataFrame


def read_books(spark: SparkSession, folder: str, recursive: bool = False) -> Books:
    """Every archive of a folder, text as UTF-8.

    A book that is broken, protected, too large for the format or without a
    package is a row of ``errors`` with its code; the others are not held up.
    """
    ship(spark)
    return books_of(archive.entries(archive.archives(spark, folder, recursive)))


def books_of(raw: DataFrame) -> Books:
    """The tables of the entries of archives."""
    broken = raw.where("error is not null").select("book_id", F.lit("archive").alias("code"), F.col("error").alias("message"))
    refused = archive.refused(raw.where("error is null"))
    kept = archive.first_wins(raw).join(refused.select("book_id").distinct(), "book_id", "left_anti")
    e = charset.normalized(kept)
    m = archive.manifest(e)
    f = archive.facts(e)
    read = f.select("book_id").distinct()
    lost = e.select("book_id").distinct().join(read, "book_id", "left_anti").join(archive.package_paths(e).withColumn("named", F.lit(True)), "book_id", "left")
    unreadable = lost.select("book_id", F.when(F.col("named"), "package").otherwise("container").alias("code"), F.when(F.col("named"), "the package document can't be read").otherwise("the container names no package").alias("message"))
    return Books(e, m, archive.spine(e), archive.toc(e, m), archive.metadata(f), broken.unionByName(refused).unionByName(unreadable), raw, f)


def readable_spine(b: Books) -> DataFrame:
    return lint.readable_spine(b.spine, b.manifest)


archive_spine = readable_spine


def check(b: Books, caps: profiles.Caps | None = None) -> DataFrame:
    """All findings: one lazy query per rule, united; with ``caps`` also what a device would not show."""
    raw = b.raw.where("error is null")
    first = archive.first_wins(b.raw)
    opf = archive.package_paths(first)
    spine_paths = readable_spine(b)
    content = b.entries.join(spine_paths.select("book_id", "path").distinct(), ["book_id", "path"], "left_semi")
    nodes = html.nodes(content, F.concat("book_id", F.lit("\n"), "path"), F.make_valid_utf8(F.col("data").cast("string")))
    ids = nodes.where(F.col("attrs")["id"].isNotNull()).select(F.substring_index("doc", "\n", 1).alias("book_id"), F.substring_index("doc", "\n", -1).alias("path"), F.col("attrs")["id"].alias("id"))
    typed = lint.declared_types(first, b.manifest)
    parts = [
        lint.mimetype_first(raw), lint.zip64(raw), lint.collisions(archive.collisions(b.raw)), lint.package_pointer(first, opf, archive.package_documents(first)), lint.manifest_sync(first, b.manifest, opf), lint.spine(b.spine, b.manifest),
        lint.toc_targets(b.toc, spine_paths, ids), lint.duplicate_ids(ids), lint.content_wellformed(content), lint.fonts(b.manifest), lint.encoding(typed),
    ]
    if caps is not None:
        parts += [lint.image_format(typed, caps), lint.css_caps(first.where(paths.extension(F.col("path")) == "css"), caps)]
    out = lint.findings(archive.rights_managed(first).where("drm"), "error", "drm", F.lit("rights management"), F.lit("META-INF/encryption.xml"))
    for p in parts:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Fitted:
    """What a run gives: archives, the metadata they hold, what was done, and pages that are no XML, whose books must not be written."""

    archives: DataFrame
    metadata: DataFrame
    transformations: DataFrame
    failures: DataFrame


STEPS_OF = {"dedupe_ids": "ids", "boxes": "boxes", "lists": "lists", "code": "code", "links": "links"}
PAGE = "book_id string, path string, html string, css string, done array<struct<kind:string,n:int>>, aliases array<struct<id:string,onto:string>>, error string"


def _fit_pages(o: profiles.Options, rules: list[filters.Rule]):
    steps = tuple(s for f, s in STEPS_OF.items() if o.on(f))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for book, path, data in pdf.itertuples(index=False):
                root = transforms.tree(bytes(data).decode("utf-8", "replace"))
                done = [(k, n) for k, n in pages.apply_rules(root, rules).items() if n] if rules else []
                sheet, alias = "", {}
                if o.on("styles"):
                    sheet, n = pages.lift_styles(root)
                    done += [("styles", n)] if n else []
                if o.on("tables") and (n := pages.tables_to_text(root)):
                    done.append(("tables", n))
                done += [(s, n) for s in steps if (n := transforms._RUN[s](root))]
                if o.on("anchors"):
                    n, alias = pages.relocate_ids(root)
                    done += [("anchors", n)] if n else []
                if o.on("text"):
                    transforms.compose_text(root)
                rows.append((book, path, transforms.serialize(root), sheet, [{"kind": k, "n": n} for k, n in done], [{"id": k, "onto": v} for k, v in alias.items()], None))
            yield pd.DataFrame(rows, columns=["book_id", "path", "html", "css", "done", "aliases", "error"])

    return run


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for book, path, text in pdf.itertuples(index=False):
            out = pages.document(transforms.tree(text))
            rows.append((book, path, out, pages.wellformed_error(out)))
        yield pd.DataFrame(rows, columns=["book_id", "path", "text", "error"])


def fit_tables(b: Books, o: profiles.Options, docs: DataFrame | None = None, mode: str = "fill", rules: list[filters.Rule] | None = None, cleared: Column | None = None, stamp: str | None = None, at: Column | None = None) -> Fitted:
    """Books fitted to options: metadata laid over and ruled, files dropped, pages rewritten, long ones divided, written anew.

    Pages are one narrow map; what they must know of each other (aliases, parts)
    travels by book; then a second map. What several later steps read is cut off
    by a checkpoint, so no page is rewritten twice; these run at once.
    """
    every = [*o.rules, *(rules or ())]
    meta = b.metadata if docs is None and cleared is None else merge.apply_documents(b.metadata, docs if docs is not None else _no_documents(b), mode, cleared)
    if every:
        meta = filters.metadata_rules(meta, every)
    if o.on("text"):
        meta = meta.withColumns({c: tx.clean_string(F.col(c)) for c in ("title", "description", "publisher", "rights")})
    meta = checkpointed(meta)
    toc = filters.toc_rules(b.toc, every) if every else b.toc
    # the small tables of the books: read once, used by many steps
    spine = checkpointed(readable_spine(b).select("book_id", "ord", "path"))
    shell = checkpointed(package.shells(b.entries, b.manifest, b.metadata))
    resources = checkpointed(package.resources_of(b.entries, b.manifest).join(meta.select("book_id"), "book_id", "left_semi"))  # of books that could be read
    protected = spine.select("book_id", "path").unionByName(shell.select("book_id", F.explode(F.array_compact(F.array("opf_path", "nav_path", "ncx_path"))).alias("path"))).distinct()
    if any(r.applies_to("file") for r in every):
        gone = filters.drop_resources(resources.select("book_id", "path"), protected, every)
        resources = resources.join(gone, ["book_id", "path"], "left_anti")
    if o.on("fonts"):
        resources = resources.where(~paths.is_font(F.col("path"), F.col("media_type")))
    entries = b.entries.join(resources.select("book_id", "path"), ["book_id", "path"], "left_semi").select("book_id", "ord", "path", "data")
    inside = spine.select("book_id", "path").distinct()
    done = entries.join(inside, ["book_id", "path"], "left_semi").where("data is not null").select("book_id", "path", "data").mapInPandas(_fit_pages(o, every), PAGE)
    done = checkpointed(done)  # every page is rewritten once, then read for its text, its aliases and the report
    texts = done.select("book_id", "path", "html")
    if o.on("anchors"):
        followed = pages.follow_aliases(texts, done.select("book_id", "path", F.inline("aliases")))
        texts = followed.select("book_id", "path", F.col("xhtml").alias("html"))
    pictures = None
    if o.on("images") and o.caps.max_width:
        # a picture is worked on once; pages follow its new names, files its new bytes
        raster_ = entries.join(inside, ["book_id", "path"], "left_anti").join(resources.select("book_id", "path", "media_type"), ["book_id", "path"]).where(images.is_candidate(F.col("data"), F.col("media_type")))
        shown = raster_.join(shell.select("book_id", F.col("cover").alias("path"), F.lit(True).alias("cover")), ["book_id", "path"], "left")
        pictures = checkpointed(raster.process_images(shown.select("book_id", "path", "data", F.coalesce("cover", F.lit(False)).alias("cover")), o.caps, o.quality, o.on("split")).where("data is not null"))
        renames = pictures.groupBy("book_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("tile", "new_path"))), lambda x: x["new_path"]).alias("parts"))
        texts = pages.rename_images(texts, renames).select("book_id", "path", F.col("xhtml").alias("html"))
        shell = shell.join(renames.select("book_id", F.col("path").alias("cover"), F.col("parts")[0].alias("_new")), ["book_id", "cover"], "left").withColumn("cover", F.coalesce("_new", "cover")).drop("_new")
    new_spine = spine
    if o.on("split"):
        parts = checkpointed(pages.retarget_parts(checkpointed(pages.split_pages(texts, o.chapter_kb * 1024))))
        new_spine = pages.retarget_spine(spine, parts)
        toc = pages.retarget_toc(toc, parts)
        texts = parts.select("book_id", F.col("part_path").alias("path"), F.col("xhtml").alias("html"), F.col("path").alias("source"))
    else:
        texts = texts.withColumn("source", F.col("path"))
    finished = checkpointed(texts.select("book_id", "path", "html").mapInPandas(_finish, "book_id string, path string, text string, error string"))
    failures = finished.where("error is not null").select("book_id", F.lit("wellformed").alias("code"), F.concat("path", F.lit(": "), "error").alias("message"))
    place = texts.select("book_id", "path", "source").join(entries.select("book_id", F.col("path").alias("source"), "ord"), ["book_id", "source"])
    page_rows = finished.join(place, ["book_id", "path"]).select("book_id", "ord", "path", F.encode("text", "utf-8").alias("data"))
    others = entries.join(inside, ["book_id", "path"], "left_anti")
    if o.on("css"):
        others = _fit_sheets(others, o)
    if pictures is not None:
        done_with = pictures.select("book_id", "path").distinct()
        fresh = pictures.join(others.select("book_id", "path", "ord"), ["book_id", "path"]).select("book_id", "ord", F.col("new_path").alias("path"), "data")
        others = others.join(done_with, ["book_id", "path"], "left_anti").unionByName(fresh)
    all_files = checkpointed(others.unionByName(page_rows))
    listed = all_files.select("book_id", "ord", "path").join(resources.select("book_id", "path", "media_type"), ["book_id", "path"], "left").withColumn("media_type", F.coalesce("media_type", paths.media_type(F.col("path"))))
    made = checkpointed(package.documents(meta, listed, new_spine, toc, shell, stamp, o.profile if stamp else None, at))
    out = package.write_books(all_files, made).join(failures.select("book_id").distinct(), "book_id", "left_anti")
    return Fitted(out, meta, done.select("book_id", "path", F.inline("done")), failures)


def _no_documents(b: Books) -> DataFrame:
    return b.metadata.select("book_id", F.lit(None).cast("string").alias("title")).limit(0)


def _fit_sheets(files: DataFrame, o: profiles.Options) -> DataFrame:
    """Style sheets brought to what the device reads, divided where they are too long; the parts of a sheet follow it."""
    is_css = paths.extension(F.col("path")) == "css"
    key = F.concat("book_id", F.lit("\n"), "path")
    sheets = files.where(is_css & F.col("data").isNotNull())
    r = css.rules(sheets, key, F.make_valid_utf8(F.col("data").cast("string")))
    small = css.emit(css.sanitized(r) if o.on("sanitize_css") else css.subset(r))
    text = sheets.select("book_id", "ord", "path", key.alias("sheet")).join(small, "sheet", "left").withColumn("css", F.coalesce("css", F.lit("")))
    cut = css.split_by_bytes(F.col("css"), o.caps.css_bytes) if o.caps.css_bytes else F.array("css")
    parts = text.select("book_id", "ord", "path", F.posexplode(cut).alias("part", "text"))
    new = parts.select("book_id", "ord", css.part_path(F.col("path"), F.col("part") + 1).alias("path"), F.encode("text", "utf-8").alias("data"))
    return files.where(~is_css).unionByName(new)


def fit(b: Books, rules: list[filters.Rule] | None = None, docs: DataFrame | None = None, mode: str = "fill", options: profiles.Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(archives, metadata) of books fitted to options, by default a plain repair."""
    out = fit_tables(b, options or profiles.Options(), docs, mode, rules)
    return out.archives, out.metadata


def plan(inputs: DataFrame, appendix: str, known: DataFrame, stamped: DataFrame | None = None, existing: DataFrame | None = None, scanned: bool = True, in_place: bool = False) -> DataFrame:
    """A batch before it runs: ``inputs`` (book_id, folder, file_name) with ``output``, ``status`` and ``reason``.

    Of scanned folders outputs of earlier runs, books with a mark and outputs
    that exist are skipped; an output that an earlier input has is a failure.
    ``known`` holds suffixes (suffix) of earlier outputs, in small letters.
    """
    from bookspark.operators import naming

    p = naming.output_names(inputs, None, appendix, in_place).withColumn("_low", F.lower("file_name"))
    prior = p.join(F.broadcast(known.select("suffix").distinct()), F.endswith("_low", "suffix"), "left_semi").select("book_id", "folder", "file_name").withColumn("_prior", F.lit(True))
    p = p.join(prior, ["book_id", "folder", "file_name"], "left")
    p = p.join(stamped.select("book_id").distinct().withColumn("_stamped", F.lit(True)), "book_id", "left") if stamped is not None else p.withColumn("_stamped", F.lit(None).cast("boolean"))
    p = p.join(existing.select("folder", F.col("file_name").alias("output")).distinct().withColumn("_there", F.lit(True)), ["folder", "output"], "left") if existing is not None else p.withColumn("_there", F.lit(None).cast("boolean"))
    skip = F.when(F.col("_prior"), "an output of an earlier run").when(F.col("_stamped"), "fitted before").when(F.col("_there") & ~F.lit(in_place), "the output exists") if scanned else F.lit(None).cast("string")
    clash = F.when(F.col("clash"), "another input has this output")
    status = F.when(skip.isNotNull(), "skipped").when(clash.isNotNull(), "failed").otherwise("planned")
    return p.withColumn("status", status).withColumn("reason", F.coalesce(skip, clash)).select("book_id", "folder", "file_name", "output", "status", "reason")


def batch_report(outcomes: DataFrame) -> DataFrame:
    """One JSON document with schema version, summary counts and the outcomes (status, …) in order of name: the row of a report, not its books, reaches one task."""
    rows = outcomes.select(F.struct(*[F.col(c) for c in outcomes.columns]).alias("r"))
    one = rows.agg(F.array_sort(F.collect_list("r")).alias("results"), F.count_if(F.col("r.status") == "done").alias("done"), F.count_if(F.col("r.status") == "failed").alias("failed"), F.count_if(F.col("r.status") == "skipped").alias("skipped"))
    return one.select(F.to_json(F.struct(F.lit(1).alias("schema"), F.struct("done", "failed", "skipped").alias("summary"), "results")).alias("report"))


def run_reports(transformations: DataFrame, warnings: DataFrame, stats: DataFrame) -> DataFrame:
    """(book_id, report): per book one JSON document of what was done, what was odd, and the figures."""
    t = transformations.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("path", "kind", "n"))).alias("transformations"))
    w = warnings.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("message", "path"))).alias("warnings"))
    j = stats.join(t, "book_id", "left").join(w, "book_id", "left")
    cols = [c for c in stats.columns if c != "book_id"]
    return j.select("book_id", F.to_json(F.struct(F.lit(1).alias("schema"), F.struct(*cols).alias("stats"), "transformations", "warnings")).alias("report"))


def failures_json(errors: DataFrame) -> DataFrame:
    """(book_id, report): errors as a machine reads them."""
    return errors.select("book_id", F.to_json(F.struct(F.lit(1).alias("schema"), F.struct("code", "message").alias("error"))).alias("report"))


def read_report(reports: DataFrame, schema: str) -> DataFrame:
    """Reports (report) of schema version 1; another version is an error."""
    return reports.select(F.from_json("report", f"schema int, {schema}").alias("r")).select(F.when(F.col("r.schema") == 1, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("schema "), F.coalesce(F.col("r.schema").cast("string"), F.lit("none")), F.lit(" is not known")))).alias("r")).select("r.*")


def show_metadata(b: Books) -> DataFrame:
    """(book_id, document, missing, cover, fitted): each book's metadata as a document, what it lacks, its cover and its mark."""
    m = b.metadata
    doc = F.to_json(F.struct(*[c for c in m.columns if c not in ("book_id", "cover_id")]))
    j = m.select("book_id", doc.alias("document"), merge.missing_fields().alias("missing"))
    return j.join(archive.covers(m, b.manifest).withColumnRenamed("path", "cover"), "book_id", "left").join(package.stamps(b.facts).select("book_id", "fitted"), "book_id", "left")


def cover_bytes(b: Books) -> DataFrame:
    """(book_id, path, data) of each cover."""
    return b.entries.join(archive.covers(b.metadata, b.manifest), ["book_id", "path"]).select("book_id", "path", "data")


__all__ = ["Books", "Fitted", "batch_report", "books_of", "check", "cover_bytes", "failures_json", "fit", "fit_tables", "plan", "profiles", "read_books", "read_report", "run_reports", "show_metadata"]
