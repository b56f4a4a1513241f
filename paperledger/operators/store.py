"""Operators over the store: documents, companies, users, export jobs, audit log, device tokens.

Times that a rule compares with "now" are an argument ``as_of`` (a timestamp column or literal), so a
job can be repeated. Limits outside their range fall back to the default, as the service has it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ZERO_COMPANY = -1


def hours(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0) + n)


def _scope(documents: DataFrame, owner, company_ids: Sequence | None, status, archive: str) -> DataFrame:
    """The predicate that list_documents and count_documents share."""
    out = documents
    if owner is not None:
        out = out.where(F.col("owner_id") == owner)
    if company_ids is not None:
        out = out.where(F.col("company_id").isin(*company_ids) if company_ids else F.lit(False))
    if status:
        out = out.where(F.col("status") == status)
    if archive == "only":
        out = out.where("archived_at is not null")
    elif archive != "all":
        out = out.where("archived_at is null")
    return out


def with_company(documents: DataFrame, companies: DataFrame) -> DataFrame:
    """J1. Documents with their company's name, blank where there is none. Spark broadcasts the
    companies when they are under its threshold."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return documents.join(names, "company_id", "left").withColumn("company_name", F.coalesce("company_name", F.lit("")))


def list_documents(documents: DataFrame, companies: DataFrame, owner=None, company_ids: Sequence | None = None, status=None, archive: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """F1. A page of documents, newest first: Spark takes the top rows of each task, then joins."""
    limit = limit if 1 <= limit <= 500 else 50
    page = _scope(documents, owner, company_ids, status, archive).orderBy(F.desc("created_at"), F.desc("id")).offset(max(offset, 0)).limit(limit)
    return with_company(page, companies)


def count_documents(documents: DataFrame, owner=None, company_ids: Sequence | None = None, status=None, archive: str = "") -> DataFrame:
    """F2."""
    return _scope(documents, owner, company_ids, status, archive).agg(F.count(F.lit(1)).alias("n"))


def visible_companies(users: DataFrame, links: DataFrame) -> DataFrame:
    """F3. user_id, company_id, sees_all: admins and operators without a company see all (company null);
    others their own company, accountants also those assigned to them."""
    sees_all = (F.col("role") == "admin") | ((F.col("role") == "operator") & F.col("company_id").isNull())
    everything = users.where(sees_all).select(F.col("id").alias("user_id"), F.lit(None).cast("bigint").alias("company_id"), F.lit(True).alias("sees_all"))
    own = users.where(~sees_all & F.col("company_id").isNotNull()).select(F.col("id").alias("user_id"), "company_id")
    assigned = links.join(users.where("role = 'accountant'").select(F.col("id").alias("user_id")), "user_id").select("user_id", "company_id")
    return everything.unionByName(own.union(assigned).distinct().withColumn("sees_all", F.lit(False)))


def visible_documents(users: DataFrame, documents: DataFrame, links: DataFrame) -> DataFrame:
    """F4. user_id and document id of all that each user may see. Clients see what they own, the others
    the documents of their companies; users who see everything are not multiplied with all documents:
    they get one row with a null document id."""
    scope = visible_companies(users.where("role <> 'client'"), links)
    docs = documents.select(F.col("id").alias("document_id"), "owner_id", "company_id")
    owned = users.where("role = 'client'").select(F.col("id").alias("user_id")).join(docs, F.col("user_id") == F.col("owner_id")).select("user_id", "document_id")
    bound = scope.where("not sees_all").join(docs, "company_id").select("user_id", "document_id")
    everything = scope.where("sees_all").select("user_id", F.lit(None).cast("bigint").alias("document_id"))
    return owned.union(bound).union(everything)


def visible_totals(users: DataFrame, documents: DataFrame, links: DataFrame) -> DataFrame:
    """F4 counted: user_id, n and ids (number and sum of the ids of what visible_documents gives each user; one
    and 0 for users who see everything). Documents are summed by company and by owner first, so no user is
    multiplied with documents."""
    scope = visible_companies(users.where("role <> 'client'"), links)
    total = lambda key: documents.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
    owned = users.where("role = 'client'").select(F.col("id").alias("user_id")).join(total("owner_id").withColumnRenamed("owner_id", "user_id"), "user_id").select("user_id", "n", "ids")
    bound = scope.where("not sees_all").join(total("company_id"), "company_id").select("user_id", "n", "ids")
    everything = scope.where("sees_all").select("user_id", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("ids"))
    return owned.union(bound).union(everything).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


def expired_archived(documents: DataFrame, companies: DataFrame, keep_days: int, as_of: Column, limit: int = 500) -> DataFrame:
    """F5. Archived for longer than keep_days, oldest first; nothing if keep_days is not positive."""
    limit = limit if 1 <= limit <= 1000 else 500
    old = documents.where(F.col("archived_at") < as_of - hours(24 * keep_days)) if keep_days > 0 else documents.limit(0)
    return with_company(old.orderBy("archived_at", "id").limit(limit), companies)


def retention_days_left(documents: DataFrame, keep_days: int, as_of: Column) -> DataFrame:
    """F6. Days until deletion, rounded up, and a label; null and "unlimited" without a limit."""
    end = F.unix_timestamp("archived_at") + 86400 * keep_days
    left = F.when(F.lit(keep_days > 0) & F.col("archived_at").isNotNull(), F.ceil((end - F.unix_timestamp(as_of)) / 86400.0))
    label = F.when(left.isNull(), "unlimited").when(left <= 0, "deleting").when(left <= 3, "urgent").otherwise("normal")
    return documents.select("id", left.cast("bigint").alias("days_left"), label.alias("label"))


def unacknowledged_exports(documents: DataFrame, as_of: Column, older_than_hours: int = 48) -> DataFrame:
    """F7. How many exported documents have no feedback and weren't touched for that long."""
    silent = (F.col("status") == "exported") & (F.coalesce("onec_status", F.lit("")) == "") & (F.col("updated_at") < as_of - hours(older_than_hours))
    return documents.where(silent).agg(F.count(F.lit(1)).alias("n"))


def awaiting_approval(documents: DataFrame, company_ids: Sequence | None = None) -> DataFrame:
    """F8."""
    waiting = documents.where("status = 'needs_approval'")
    if company_ids is not None:
        waiting = waiting.where(F.col("company_id").isin(*company_ids) if company_ids else F.lit(False))
    return waiting.agg(F.count(F.lit(1)).alias("n"))


def claimable_exports(jobs: DataFrame, as_of: Column) -> DataFrame:
    """F9. All pending jobs that are due, by the time of the next attempt within each partition of the output."""
    return jobs.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= as_of)).orderBy("next_attempt_at", "id")


def claimable_documents(documents: DataFrame) -> DataFrame:
    """F9. All received documents by creation."""
    return documents.where("status = 'received'").orderBy("created_at", "id")


def archives_on(status: Column, statuses: Sequence[str] = ("posted",)) -> Column:
    """F23."""
    return F.coalesce(status.isin(*statuses), F.lit(False))


def block_reason(documents: DataFrame, catalogue: DataFrame) -> DataFrame:
    """F18. Why a document can't be sent; blank if it can."""
    routable = catalogue.where(F.trim("object") != "").select(F.col("slug").alias("doc_type"), F.lit(True).alias("routable"))
    reason = (
        F.when(F.col("status") == "exported", "exported")
        .when(F.col("status") == "needs_approval", "waits for approval")
        .when(F.col("status") == "rejected", "returned")
        .when(F.col("status").isin("received", "processing", "failed"), "not recognised")
        .when(F.col("routable").isNull(), "no target")
        .otherwise("")
    )
    return documents.join(routable, "doc_type", "left").select("id", reason.alias("reason"))


def apply_decisions(documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """F25. The latest decision of each document (document_id, decision, note, actor_id, decided_at) as
    old and new status, export job kind, audit action and reason of refusal."""
    latest = decisions.groupBy(F.col("document_id").alias("id")).agg(F.max_by(F.struct("decision", "note", "actor_id"), F.struct("decided_at", "decision")).alias("d")).select("id", "d.*")
    d, status = F.col("decision"), F.col("status")
    recognised = status.isin("confirmed", "needs_input", "needs_review", "needs_approval", "rejected")
    refused = (
        F.when(d == "confirm", F.when(status == "exported", "already exported").when(~recognised, "not recognised"))
        .when(d == "approve", F.when(~status.isin("needs_approval", "rejected"), "nothing to approve"))
        .when(d == "reject", F.when(F.trim(F.coalesce("note", F.lit(""))) == "", "a note is needed").when(status != "needs_approval", "nothing to reject"))
        .when(d == "reprocess", F.when(status == "exported", "already exported"))
        .otherwise("unknown decision")
    )
    after = F.when(d.isin("confirm", "approve"), "confirmed").when(d == "reject", "rejected").otherwise("received")
    out = documents.join(latest, "id").withColumn("refused", refused)
    ok = F.col("refused").isNull()
    return out.select("id", "decision", "actor_id", status.alias("old_status"), F.when(ok, after).otherwise(status).alias("new_status"), F.when(ok & d.isin("confirm", "approve"), "create").alias("job_kind"), F.when(ok, d).alias("audit_action"), "refused")


def resolve_upload_company(uploads: DataFrame, users: DataFrame, companies: DataFrame) -> DataFrame:
    """F26. Company of each upload (id, user_id, company_id asked for or null), or why it is refused."""
    who = users.select(F.col("id").alias("user_id"), "role", F.col("company_id").alias("own_company"))
    what = companies.select(F.col("id").alias("wanted"), "is_active")
    wanted = F.coalesce("company_id", "own_company")
    rows = uploads.join(who, "user_id", "left").withColumn("wanted", wanted).join(what, "wanted", "left")
    foreign = F.col("own_company").isNotNull() & (F.col("wanted") != F.col("own_company")) & (F.col("role") != "admin")
    reason = F.when(F.col("wanted").isNull(), F.lit(None).cast("string")).when(F.col("is_active").isNull(), "unknown company").when(~F.col("is_active"), "inactive company").when(foreign | (F.col("role") == "client") & (F.col("own_company").isNull()), "no right to this company")
    return rows.select("id", F.when(reason.isNull(), F.col("wanted")).alias("company_id"), reason.alias("refused"))


def backfill_archive(documents: DataFrame) -> DataFrame:
    """F27. archived_at of documents that were closed before the column was there."""
    closed = archives_on(F.col("onec_status")) & F.col("archived_at").isNull()
    return documents.withColumn("archived_at", F.when(closed, F.coalesce("onec_updated_at", "updated_at")).otherwise(F.col("archived_at")))


def export_batch(jobs: DataFrame, documents: DataFrame, companies: DataFrame, as_of: Column) -> DataFrame:
    """J5. Due jobs with document and company; a job whose document is missing has an error."""
    docs = documents.select(F.col("id").alias("document_id"), F.col("status").alias("document_status"), "company_id", "owner_id")
    rows = jobs.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= as_of)).select(F.col("id").alias("job_id"), "document_id", "kind", "attempts").join(docs, "document_id", "left")
    return with_company(rows, companies).withColumn("error", F.when(F.col("document_status").isNull(), "document not found"))


def company_accountants(users: DataFrame, links: DataFrame, company) -> DataFrame:
    """J6. Accountants assigned to a company, by login."""
    return links.where(F.col("company_id") == company).join(users.select(F.col("id").alias("user_id"), "login", "is_active"), "user_id").select("user_id", "login", "is_active").orderBy("login")


def orphans(rows: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """J21. Rows whose key the dimension lacks."""
    return rows.where(F.col(key).isNotNull()).join(dimension.select(F.col(dimension_key).alias(key)), key, "left_anti")


def apply_exchange(target: DataFrame, messages: DataFrame) -> DataFrame:
    """J22. Receiver's upsert by source_id: the latest create or partial message replaces the record,
    update messages fill what is missing; repeated messages change nothing. Messages: source_id,
    kind, seq, number, date, total (null: not given)."""
    values = ("number", "date", "total")
    last = F.max_by(F.struct("seq", *values), "seq")
    full = messages.where("kind in ('create', 'partial')").groupBy("source_id").agg(last.alias("m"))
    new = full.select("source_id", "m.seq", *(F.col(f"m.{v}").alias(f"new_{v}") for v in values), F.lit(True).alias("replaced"))
    base = target.join(new, "source_id", "full_outer").select("source_id", F.coalesce("seq", F.lit(-1)).alias("seq"), *(F.when(F.col("replaced"), F.col(f"new_{v}")).otherwise(F.col(v)).alias(v) for v in values))
    later = messages.where("kind = 'update'").select("source_id", F.col("seq").alias("at"), *(F.col(v).alias(f"new_{v}") for v in values)).join(base.select("source_id", "seq"), "source_id").where("at > seq")
    filled = later.groupBy("source_id").agg(*(F.min_by(f"new_{v}", F.when(F.col(f"new_{v}").isNotNull(), F.col("at"))).alias(f"new_{v}") for v in values))
    return base.join(filled, "source_id", "left").select("source_id", *(F.coalesce(v, f"new_{v}").alias(v) for v in values))


def store_integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """A23. Rows of each table."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionAll(n)
    return out


def check_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """A23. Documents whose file (storage_key, content) is missing or has another digest."""
    rows = documents.select("id", "storage_key", "sha256").join(files.select("storage_key", F.sha2("content", 256).alias("found")), "storage_key", "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "other content")
    return rows.select("id", problem.alias("problem")).where("problem is not null")


def duplicate_uploads(documents: DataFrame) -> DataFrame:
    """A25. Same file uploaded more than once to a company."""
    return documents.groupBy("company_id", "sha256").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def count_active_admins(users: DataFrame, excluding=None) -> DataFrame:
    """A27."""
    return users.where((F.col("role") == "admin") & F.col("is_active") & (F.lit(excluding).isNull() | (F.col("id") != F.lit(excluding)))).agg(F.count(F.lit(1)).alias("n"))


def upsert_device_tokens(tokens: DataFrame, incoming: DataFrame, removed: DataFrame) -> DataFrame:
    """A28. Latest owner and platform of each token (token, user_id, platform, ts), without removed ones."""
    both = tokens.unionByName(incoming)
    return both.groupBy("token").agg(F.max_by(F.struct("user_id", "platform"), F.struct("ts", "user_id")).alias("t")).select("token", "t.*").join(removed.select("token"), "token", "left_anti")


def latest_audit(audit: DataFrame, limit: int = 100) -> DataFrame:
    """K1. Newest entries: a top-k, not a sort of the log."""
    return audit.orderBy(F.desc("created_at"), F.desc("id")).limit(limit if 1 <= limit <= 500 else 100)


def page_append(shown: DataFrame, page: DataFrame) -> DataFrame:
    """K3. The next page without ids already shown."""
    return page.join(shown.select("id"), "id", "left_anti")


def list_companies(companies: DataFrame, ids: Sequence | None = None) -> DataFrame:
    """K4."""
    rows = companies if ids is None else companies.where(F.col("id").isin(*ids) if ids else F.lit(False))
    return rows.orderBy("name", "id")


def list_users(users: DataFrame) -> DataFrame:
    """K4."""
    return users.orderBy("created_at", "id")


def seed_counterparties(documents: DataFrame, companies: DataFrame) -> DataFrame:
    """A9. A directory from exported documents (company_id, unp, name): per company and valid id the
    most frequent spelling (of equal ones the smallest) and the other spellings as synonyms; never
    the company itself. Spellings are counted before names meet, so a company with very many
    documents sends one row for each spelling."""
    from ..functions.parties import party_key, same_key

    key = F.coalesce("company_id", F.lit(ZERO_COMPANY)).alias("company_key")
    rows = documents.where("status = 'exported'").where(F.col("unp").rlike("^[0-9]{9}$") & (F.trim("name") != "")).groupBy(key, "unp", F.trim("name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    own = companies.select(F.col("id").alias("company_key"), F.col("unp").alias("own_unp"), party_key(F.col("name")).alias("own_key"))
    rows = rows.join(own, "company_key", "left").where(~F.coalesce((F.col("own_unp") == F.col("unp")) | same_key(party_key(F.col("name")), F.col("own_key")), F.lit(False)))
    best = rows.groupBy("company_key", "unp").agg(F.collect_list(F.struct((-F.col("n")).alias("m"), "name")).alias("all"))
    ordered = F.array_sort("all")
    names = F.transform(ordered, lambda x: x["name"])
    return best.select("company_key", "unp", names[0].alias("name"), F.array_sort(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(1)))).alias("synonyms"))


def upsert_counterparty(directory: DataFrame, incoming: DataFrame) -> DataFrame:
    """A10. Directory (company_key, unp, name, synonyms) after spellings (company_key, unp, name) came in."""
    spellings = incoming.where((F.trim("unp") != "") & (F.trim("name") != "")).groupBy("company_key", "unp").agg(F.array_sort(F.collect_set(F.trim("name"))).alias("came"))
    rows = directory.join(spellings, ["company_key", "unp"], "full_outer")
    name = F.coalesce("name", F.get("came", F.lit(0)))
    had = F.coalesce("synonyms", F.array().cast("array<string>"))
    folded = F.transform(F.concat(F.array(name), had), lambda x: F.lower(x))
    new = F.filter(F.coalesce("came", F.array().cast("array<string>")), lambda x: ~F.array_contains(folded, F.lower(x)))
    # of new spellings that differ in case only the first is kept
    kept = F.aggregate(new, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))
    return rows.select("company_key", "unp", name.alias("name"), F.concat(had, kept).alias("synonyms"))


def counterparty_by_tax_id(docs: DataFrame, directory: DataFrame) -> DataFrame:
    """J2. Canonical name by company (or none) and tax id."""
    key = F.coalesce("company_id", F.lit(ZERO_COMPANY))
    return docs.withColumn("company_key", key).join(directory.select("company_key", "unp", F.col("name").alias("canonical")), ["company_key", "unp"], "left").drop("company_key")


def counterparty_by_name(docs: DataFrame, directory: DataFrame) -> DataFrame:
    """J3. doc_id and the directory entry that its name matches, if exactly one does: equal keys, or the
    shorter key has six characters or more and is part of the longer one.

    Blocked instead of compared pairwise: if one key contains another of six characters or more, the
    first six characters of the shorter are among the six-character pieces of the longer. So pieces
    of each side meet the beginnings of the other; distinct names are matched once, however many
    documents have them.
    """
    from ..functions.parties import party_key, same_key

    docs = docs.select("doc_id", F.coalesce("company_id", F.lit(ZERO_COMPANY)).alias("company_key"), party_key(F.col("name")).alias("key"))
    names = docs.where("key <> ''").select("company_key", "key").distinct()
    entries = directory.select("company_key", "unp", F.col("name").alias("canonical"), F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>"))))).alias("spelling"))
    entries = entries.select("company_key", "unp", "canonical", party_key(F.col("spelling")).alias("entry_key")).where("entry_key <> ''").distinct()

    def head(c: str) -> Column:
        return F.substring(c, 1, 6)

    def pieces(c: str) -> Column:
        return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 5, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(6)))))

    forward = names.withColumn("block", head("key")).join(entries.withColumn("block", pieces("entry_key")), ["company_key", "block"])
    backward = names.withColumn("block", pieces("key")).join(entries.withColumn("block", head("entry_key")), ["company_key", "block"])
    columns = ("company_key", "key", "entry_key", "unp", "canonical")
    hits = forward.select(*columns).union(backward.select(*columns)).where(same_key(F.col("key"), F.col("entry_key"))).select("company_key", "key", "unp", "canonical").distinct()
    single = hits.groupBy("company_key", "key").agg(F.count(F.lit(1)).alias("n"), F.min("unp").alias("unp"), F.min("canonical").alias("canonical")).where("n = 1").drop("n")
    return docs.join(single, ["company_key", "key"]).select("doc_id", "unp", "canonical")


def status_changes(snapshots: DataFrame, statuses: Sequence[str] = ("exported", "failed", "needs_input", "needs_approval")) -> DataFrame:
    """W27. A notice when a document that was seen before has come into one of the statuses."""
    order = Window.partitionBy("doc_id").orderBy("ts", "seq")
    seen = snapshots.withColumn("before", F.lag("status").over(order))
    return seen.where(F.col("before").isNotNull() & (F.col("before") != F.col("status")) & F.col("status").isin(*statuses)).select("doc_id", "seq", "before", "status")


def notice_text(status: Column, onec_status: Column) -> Column:
    """C29. Title and body of a notice by feedback, then by status; null if there is none."""
    text = lambda t, b: F.struct(F.lit(t).alias("title"), F.lit(b).alias("body"))
    return (
        F.when(onec_status == "posted", text("Document posted", "The accounting system has posted the document"))
        .when(onec_status == "rejected", text("Document rejected", "The accounting system has rejected the document"))
        .when(onec_status == "error", text("Error in the accounting system", "The document could not be loaded"))
        .when(status == "exported", text("Document sent", "The document was sent to the accounting system"))
        .when(status == "failed", text("Document not recognised", "Recognition has failed"))
        .when(status == "needs_input", text("Data needed", "Some fields have to be filled in"))
        .when(status == "needs_approval", text("Approval needed", "The document waits for approval"))
    )


