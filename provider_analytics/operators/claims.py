"""Ownership claims, accounts and directory-wide figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import website_url
from .skew import place_in_group, settle, top_per_group
from .writes import patch_columns

# Profile states written by claims.
VERIFIED, IN_REVIEW = "verified", "in_revisione"


def claim_status_of_owner(providers: DataFrame, claims: DataFrame) -> DataFrame:
    """Owned providers with the state of their owner's best claim: approved, pending, other; newest."""
    rank = F.when(F.col("claim_status") == "approved", 0).when(F.col("claim_status") == "pending", 1).otherwise(2)
    owned = providers.filter(F.coalesce("owner_email", F.lit("")) != "").withColumn("_email", F.lower("owner_email"))
    rows = claims.select("provider_id", F.lower("email").alias("_email"), F.col("status").alias("claim_status"), "created_at", "claim_id")
    best = top_per_group(rows, ["provider_id", "_email"], [rank, F.col("created_at").desc(), F.col("claim_id")], 1)
    return owned.join(best.drop("created_at"), ["provider_id", "_email"], "left").drop("_email")


def claim_transitions(providers: DataFrame, claims: DataFrame) -> DataFrame:
    """Ownership after a sequence of claim decisions, in the order of created_at and claim_id.

    Approved: owner and verified. Pending: owner and in review. Rejected: takes ownership away only from the
    claimant it rejects. So the last approved or pending decision of a provider names its owner, and a later
    rejection of the same email clears it; where nobody was named, a rejection may clear the owner there was."""
    moment = F.struct("created_at", "claim_id")
    decided = claims.select("provider_id", F.lower("email").alias("_email"), "status", "created_at", moment.alias("_moment"))
    named = decided.groupBy("provider_id").agg(
        F.max_by(F.struct("status", "_email"), F.when(F.col("status").isin("approved", "pending"), F.col("_moment"))).alias("_n"),
        F.max(F.when(F.col("status").isin("approved", "pending"), F.col("_moment"))).alias("_named_at"),
        F.min(F.when(F.col("status") == "approved", F.col("created_at"))).alias("_approved_at"),
    )
    refused = decided.filter("status = 'rejected'").groupBy("provider_id", "_email").agg(F.max("_moment").alias("_refused_at"))
    rows = providers.join(named, "provider_id", "left").withColumn("_status", F.when(F.col("_named_at").isNotNull(), F.col("_n.status")))
    rows = rows.withColumn("_owner", F.when(F.col("_status").isNotNull(), F.col("_n._email")).otherwise(F.col("owner_email")))
    rows = rows.withColumn("_email", F.lower("_owner")).join(refused, ["provider_id", "_email"], "left")
    cleared = F.col("_refused_at").isNotNull() & (F.col("_named_at").isNull() | (F.col("_refused_at") > F.col("_named_at")))
    profile = F.when(F.col("_status") == "approved", VERIFIED).when(F.col("_status") == "pending", IN_REVIEW).otherwise(F.col("profile_status"))
    return rows.withColumns({
        "owner_email": F.when(~cleared, F.col("_owner")),
        "profile_status": F.when(~cleared, profile),
        "claimed_at": F.coalesce("claimed_at", "_approved_at"),
    }).drop("_status", "_email", "_owner", "_n", "_named_at", "_approved_at", "_refused_at")


def decide_claims(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claims after decisions (claim_id, status, decided_at): the last one is the state; the times of the last
    approval and the last rejection stay on the row."""
    at = lambda status: F.max(F.when(F.col("_to") == status, F.col("decided_at")))
    last = decisions.withColumnRenamed("status", "_to").groupBy("claim_id").agg(
        F.max_by("_to", F.struct("decided_at", "_to")).alias("_last"), at("approved").alias("_approved"), at("rejected").alias("_rejected")
    )
    return claims.join(last, "claim_id", "left").withColumns({
        "status": F.coalesce("_last", "status"), "approved_at": F.coalesce("_approved", "approved_at"),
        "rejected_at": F.coalesce("_rejected", "rejected_at"), "verified_at": F.coalesce("_approved", "verified_at"),
    }).drop("_last", "_approved", "_rejected")


#: Rounds in which what is first on both its sides is settled, before chains are followed.
FIRST_ROUNDS = 7


def _settled_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs (_email, provider_id, _moment), in the order of time, those that find both sides free.

    A pair is final when it is the earliest open one of its email and of its provider; what shares a side with
    it is then out. After a few rounds of that, what is left hangs together in chains, which are followed at once."""
    won = None
    for _ in range(FIRST_ROUNDS):
        by_email = pairs.groupBy("_email").agg(F.min("_moment").alias("_e"))
        by_provider = pairs.groupBy("provider_id").agg(F.min("_moment").alias("_p"))
        first = pairs.join(by_email, "_email").join(by_provider, "provider_id")
        final = settle(first.filter((F.col("_moment") == F.col("_e")) & (F.col("_moment") == F.col("_p"))).drop("_e", "_p"), "claims-won")
        won = final if won is None else won.unionByName(final)
        pairs = settle(
            pairs.join(final.select("_email"), "_email", "left_anti").join(final.select("provider_id"), "provider_id", "left_anti"), "claims-open"
        )
        if pairs.isEmpty():
            return won
    return won.unionByName(_chained_pairs(pairs))


def _chained_pairs(pairs: DataFrame) -> DataFrame:
    """The same, by functions of what lies before.

    Whether a pair's email is free before it (x) is what the pair before it on that email left, and so for its provider
    (y). It wins if both are; it leaves its email free if x and not y, its provider if y and not x. With one of the two
    known, or both resting on the same earlier answer, what it leaves is a constant, that answer or its opposite. Every
    round puts what is known of the pairs before into x and y, so the way back doubles: a chain takes as
    many rounds as its length has binary digits. Only pairs with two open sides that rest on different answers wait."""
    pairs = settle(pairs.withColumn("_pair", F.monotonically_increasing_id()), "claims-numbered")
    state = pairs.select("_pair")
    # An input is (rest, flag): the flag itself if it rests on nothing, else that answer, turned round where flag is set.
    for side, key, answer in (("x", "_email", 0), ("y", "provider_id", 1)):
        placed = place_in_group(pairs.select("_pair", key, "_moment"), [key], [F.col("_moment")], "_nth")
        before = placed.select(key, (F.col("_nth") + 1).alias("_nth"), (F.col("_pair") * 2 + answer).alias(f"{side}_on"))
        given = placed.join(before, [key, "_nth"], "left").select("_pair", f"{side}_on", F.col(f"{side}_on").isNull().alias(f"{side}_flag"))
        state = state.join(given, "_pair")
    state = settle(state, "claims-state")
    while not state.filter("x_on IS NOT NULL OR y_on IS NOT NULL").isEmpty():
        left = _left_free(state)
        for side in ("x", "y"):
            known = left.select(F.col("answer").alias(f"{side}_on"), F.col("on").alias("_on"), F.col("flag").alias("_flag"))
            joined = state.join(known, f"{side}_on", "left")
            found = F.col("_flag").isNotNull()
            state = joined.withColumns({
                f"{side}_on": F.when(found, F.col("_on")).otherwise(F.col(f"{side}_on")),
                f"{side}_flag": F.when(found, F.col("_flag") != F.col(f"{side}_flag")).otherwise(F.col(f"{side}_flag")),
            }).drop("_on", "_flag")
        state = settle(state, "claims-state")
    return pairs.join(state.filter("x_flag AND y_flag").select("_pair"), "_pair").drop("_pair")


def _left_free(state: DataFrame) -> DataFrame:
    """answer, on, flag: what each pair leaves of its email (answer 2 * _pair) and provider (2 * _pair + 1), as far as it is
    known: null rows are left out."""
    x, y = (F.struct(F.col(f"{s}_on").alias("on"), F.col(f"{s}_flag").alias("flag")) for s in ("x", "y"))
    turned = lambda s: F.struct(F.col(f"{s}_on").alias("on"), (~F.col(f"{s}_flag")).alias("flag"))
    never = F.struct(F.lit(None).cast("bigint").alias("on"), F.lit(False).alias("flag"))
    fixed = lambda s, value: F.col(f"{s}_on").isNull() & (F.col(f"{s}_flag") == value)
    alike = F.col("x_on") == F.col("y_on")
    both = (
        F.when(fixed("x", False), F.array(never, y)).when(fixed("x", True), F.array(turned("y"), never))
        .when(fixed("y", False), F.array(x, never)).when(fixed("y", True), F.array(never, turned("x")))
        .when(alike & (F.col("x_flag") == F.col("y_flag")), F.array(never, never)).when(alike, F.array(x, y))
    )
    return state.select("_pair", F.posexplode(both).alias("_side", "_is")).select(
        (F.col("_pair") * 2 + F.col("_side")).alias("answer"), "_is.on", "_is.flag")


def claim_admission(claims: DataFrame, providers: DataFrame) -> DataFrame:
    """Verdict on each claim of a batch, in the order of created_at and claim_id: invalid_input,
    already_has_provider, provider_not_found, already_claimed or ok.

    An earlier claim that was admitted counts as made when later ones are judged; one that was refused does not."""
    email = F.lower(F.trim("email"))
    rows = claims.withColumns({"_email": email, "_moment": F.struct("created_at", "claim_id")})
    known = providers.filter("status = 'published'").select("provider_id", F.lower("owner_email").alias("_owner"), F.lit(True).alias("_known"))
    owns = providers.filter(F.coalesce("owner_email", F.lit("")) != "").groupBy(F.lower("owner_email").alias("_email")).agg(
        F.min("provider_id").alias("_owned")
    )
    joined = rows.join(known, "provider_id", "left").join(owns, "_email", "left")
    valid = F.coalesce(F.contains("_email", F.lit("@")), F.lit(False)) & F.col("provider_id").isNotNull()
    alone = (
        F.when(~valid, "invalid_input")
        .when(F.col("_owned").isNotNull() & (F.col("_owned") != F.col("provider_id")), "already_has_provider")
        .when(F.col("_known").isNull(), "provider_not_found")
        .when((F.coalesce("_owner", F.lit("")) != "") & (F.col("_owner") != F.col("_email")), "already_claimed")
        .otherwise("ok")
    )
    judged = joined.withColumn("verdict", alone).drop("_owner", "_known", "_owned")
    fine = judged.filter("verdict = 'ok'").groupBy("_email", "provider_id").agg(F.min("_moment").alias("_moment"))
    won = _settled_pairs(settle(fine, "claims-fine"))
    mine = won.select("_email", F.col("provider_id").alias("_got"), F.col("_moment").alias("_got_at"))
    theirs = won.select("provider_id", F.col("_email").alias("_taker"), F.col("_moment").alias("_taken_at"))
    late = (
        F.when(F.col("verdict") == "invalid_input", F.col("verdict"))
        .when((F.col("_got") != F.col("provider_id")) & (F.col("_got_at") < F.col("_moment")), "already_has_provider")
        .when(F.col("verdict") != "ok", F.col("verdict"))
        .when((F.col("_taker") != F.col("_email")) & (F.col("_taken_at") < F.col("_moment")), "already_claimed").otherwise("ok")
    )
    return judged.join(mine, "_email", "left").join(theirs, "provider_id", "left").withColumn("verdict", late).drop(
        "_email", "_moment", "_got", "_got_at", "_taker", "_taken_at"
    )


def claim_upsert(claims: DataFrame, admitted: DataFrame) -> DataFrame:
    """Claims after admitted submissions (submission_id, provider_id, email, name, created_at): the newest pending or
    approved claim of the same provider and email is opened again with the submitted name, without one a claim
    is added under the id of the first submission. Later submissions of a pair update what the first left."""
    pair = ["provider_id", "_email"]
    moment = F.struct("created_at", "submission_id")
    asked = admitted.withColumn("_email", F.lower(F.trim("email"))).groupBy(*pair).agg(
        F.min_by("submission_id", moment).alias("_first"), F.min("created_at").alias("_at"), F.max_by("name", moment).alias("_name")
    )
    held = claims.withColumn("_email", F.lower(F.trim("email")))
    open_ = top_per_group(held.filter(F.col("status").isin("pending", "approved")), pair, [F.col("created_at").desc(), F.col("claim_id").desc()], 1)
    reopened = open_.select("claim_id", *pair).join(asked.select(*pair, "_name"), pair).select("claim_id", F.col("_name").alias("_new_name"))
    none = F.lit(None).cast("timestamp_ntz")
    kept = claims.join(reopened.withColumn("_again", F.lit(True)), "claim_id", "left")
    again = F.col("_again").isNotNull()
    kept = kept.withColumns({
        "claimant_name": F.when(again, F.col("_new_name")).otherwise(F.col("claimant_name")),
        "status": F.when(again, "pending").otherwise(F.col("status")),
        "approved_at": F.when(again, none).otherwise(F.col("approved_at")),
        "rejected_at": F.when(again, none).otherwise(F.col("rejected_at")),
    }).select(*claims.columns)
    added = asked.join(open_.select(*pair), pair, "left_anti").select(
        F.col("_first").alias("claim_id"), "provider_id", F.col("_email").alias("email"), F.col("_name").alias("claimant_name"),
        F.lit("pending").alias("status"), F.col("_at").alias("created_at"),
    )
    return kept.unionByName(added, allowMissingColumns=True)


def owners_after_claims(providers: DataFrame, admitted: DataFrame) -> DataFrame:
    """Providers after admitted submissions: a free one gets the claimant as its owner; a profile without a state goes
    into review."""
    first = admitted.groupBy("provider_id").agg(F.min_by(F.lower(F.trim("email")), F.struct("created_at", "submission_id")).alias("_email"))
    mine = F.col("_email").isNotNull() & (F.coalesce(F.lower("owner_email"), F.col("_email")) == F.col("_email"))
    return providers.join(first, "provider_id", "left").withColumns({
        "owner_email": F.when(mine, F.col("_email")).otherwise(F.col("owner_email")),
        "profile_status": F.when(mine, F.coalesce(F.nullif("profile_status", F.lit("")), F.lit(IN_REVIEW))).otherwise(F.col("profile_status")),
    }).drop("_email")


def profile_update(providers: DataFrame, edits: DataFrame) -> DataFrame:
    """Owner edits (provider_id, email of the editor, and new values): contact fields are overwritten, blank
    clears them; a verified profile stays verified, any other goes into review. Edits of others are ignored."""
    columns = ["phone", "website"]
    mine = edits.withColumn("website", website_url(F.col("website"))).join(
        providers.select("provider_id", F.lower("owner_email").alias("_owner")), "provider_id"
    ).filter(F.col("_owner") == F.lower(F.trim("editor")))
    out = patch_columns(providers, mine, "provider_id", overwrite=columns)
    return out.withColumn("profile_status", F.when(
        F.col("_edited") & (F.coalesce("profile_status", F.lit("")) != VERIFIED), IN_REVIEW
    ).otherwise(F.col("profile_status"))).drop("_edited")


def claims_queue(claims: DataFrame, providers: DataFrame, limit: int = 100) -> DataFrame:
    """Pending claims first, newest first."""
    top = claims.orderBy(F.col("status") != "pending", F.col("created_at").desc(), "claim_id").limit(limit)
    return top.join(providers.select("provider_id", "full_name", "slug", "comune"), "provider_id", "left")


def accounts_recent(accounts: DataFrame, limit: int = 100) -> DataFrame:
    return accounts.orderBy(F.coalesce("last_login_at", "created_at").desc_nulls_last(), "email").limit(limit)


def union_accounts(provider_accounts: DataFrame, client_accounts: DataFrame, limit: int = 100) -> DataFrame:
    """The most recent accounts of both kinds, tagged."""
    columns = ["email", "google", "last_login_at", "created_at"]
    tagged = lambda df, kind: accounts_recent(df, limit).select(F.lit(kind).alias("kind"), *columns)
    return tagged(provider_accounts, "notary").unionByName(tagged(client_accounts, "client"))


# Directory-wide figures

def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def directory_overview(providers: DataFrame, services: DataFrame, requests: DataFrame, claims: DataFrame, properties: DataFrame,
                       observations: DataFrame, provider_services: DataFrame, now: Column) -> DataFrame:
    """Fourteen counts in one row, one pass per table; one-row results are put side by side."""
    p = providers.filter("status = 'published'").agg(
        F.count("*").alias("providers"), F.count_if(_filled("email")).alias("with_email"), F.count_if(_filled("phone")).alias("with_phone"),
        F.count_if(_filled("website")).alias("with_website"), F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("with_geo"),
        F.count_if("is_official").alias("official"),
    )
    r = requests.agg(
        F.count("*").alias("requests"), F.count_if(F.col("created_at") >= now - F.expr("INTERVAL 7 DAYS")).alias("requests_7d"),
        F.count_distinct(F.lower("requester_email")).alias("client_emails"),
    )
    one = [
        services.agg(F.count("*").alias("services")), r, claims.agg(F.count_if(F.col("status") == "pending").alias("claims_pending")),
        properties.agg(F.count_if(F.col("status") == "active").alias("properties")),
        observations.agg(F.count("*").alias("observations")), provider_services.agg(F.count("*").alias("service_links")),
    ]
    for part in one:
        p = p.crossJoin(F.broadcast(part))  # one row each
    return p


def site_stats(providers: DataFrame, services: DataFrame, benchmarks: DataFrame) -> DataFrame:
    return (
        providers.agg(F.count_if(F.col("status") == "published").alias("providers"))
        .crossJoin(F.broadcast(services.agg(F.count("*").alias("services"))))
        .crossJoin(F.broadcast(benchmarks.agg(F.count("*").alias("prices"))))
    )


def observation_breakdown(observations: DataFrame, limit: int = 40) -> DataFrame:
    unknown = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    return observations.groupBy(unknown("source"), unknown("status")).agg(F.count("*").alias("total")).orderBy(
        F.col("total").desc(), "source", "status"
    ).limit(limit)


def run_summary(results: DataFrame, unit_price: float) -> DataFrame:
    """Outcome counts of a run per source and its estimated cost."""
    return results.groupBy("source").agg(
        F.count("*").alias("processed"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "empty").alias("no_match"), F.count_if(F.col("status") == "error").alias("errors"),
        F.round(F.count("*") * F.lit(unit_price), 3).alias("estimated_cost"),
    )


def geocode_coverage(providers: DataFrame, observations: DataFrame, source: str) -> DataFrame:
    """Located, located by the source, and still to do, in one row."""
    tried = observations.filter(F.col("source") == source).groupBy("provider_id").agg(
        F.bool_or(F.col("status") == "completed").alias("_done"), F.bool_or(F.col("status").isin("completed", "empty")).alias("_settled")
    )
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return providers.join(tried, "provider_id", "left").agg(
        F.count("*").alias("total"), F.count_if(located).alias("with_coords"),
        F.count_if(F.coalesce("_done", F.lit(False))).alias("from_source"),
        F.count_if(~located & ~F.coalesce("_settled", F.lit(False))).alias("remaining"),
    )
