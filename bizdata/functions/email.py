"""E-mail columns: syntax, kinds of mailbox, scores, and address patterns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .presence import as_col, blank_to_null


def local_part(c: Column | str) -> Column:
    return F.lower(F.split_part(as_col(c), F.lit("@"), F.lit(1)))


def mail_domain(c: Column | str) -> Column:
    return F.lower(F.split_part(as_col(c), F.lit("@"), F.lit(2)))


def email_valid(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(as_col(c))).rlike(rules.EMAIL_SYNTAX), F.lit(False))


def is_disposable(c: Column | str) -> Column:
    return F.coalesce(mail_domain(c).isin(*rules.DISPOSABLE_DOMAINS), F.lit(False))


def is_consumer(c: Column | str) -> Column:
    return F.coalesce(mail_domain(c).isin(*rules.CONSUMER_DOMAINS), F.lit(False))


def is_generic(c: Column | str) -> Column:
    """Role mailbox (info@, sales@, …) or a local part that starts with a digit; a missing address counts."""
    local = local_part(c)
    hit = local.rlike("|".join(rules.GENERIC_MAILBOXES)) | local.rlike(r"^\d")
    return F.coalesce(hit, F.lit(True))


def is_personal(c: Column | str) -> Column:
    local = local_part(c)
    role = local.rlike("^(" + "|".join(rules.ROLE_MAILBOXES) + r")($|\.|_)")
    shape = local.rlike(r"^([a-z]+\.[a-z]+|[a-z]+_[a-z]+|[a-z]\.[a-z]+|[a-z][a-z]{4,})$")
    return F.coalesce(~role & shape, F.lit(False))


def guarded(pattern: str) -> str:
    """An address pattern that reads every run of a text once.

    The pattern alone starts at every character of a run and reads it to its end. All starts in one run share what
    follows the run, so the leftmost match starts where a run does, or where the match before ended (\\G).
    """
    mailbox, rest = pattern.split("+@", 1)
    return f"(?:(?<!{mailbox})|\\G){mailbox}++@{rest}"


def addresses(c: Column | str, pattern: str) -> Column:
    """All matches of an address pattern, in time linear in the text."""
    return F.regexp_extract_all(as_col(c), F.lit(guarded(pattern)), F.lit(0))


def extract_emails(c: Column | str, limit: int | None = None) -> Column:
    """Distinct addresses in order of appearance, without example and placeholder ones."""
    found = F.array_distinct(addresses(c, rules.EMAIL_IN_TEXT))
    kept = F.filter(found, lambda e: ~F.contains(e, F.lit("example.com")) & ~F.contains(e, F.lit("placeholder")))
    return kept if limit is None else F.slice(kept, 1, limit)


def site_emails(html: Column | str) -> Column:
    """Distinct lower-case addresses on a page (stricter pattern than extract_emails)."""
    return F.array_distinct(F.transform(addresses(html, rules.EMAIL_ON_SITE), F.lower))


def fake_email_reason(c: Column | str) -> Column:
    """Why an address looks made up, or NULL."""
    c = as_col(c)
    lower, local = F.lower(c), local_part(c)
    placeholder = F.exists(F.array(*[F.lit(k) for k in rules.FAKE_EMAIL_PARTS]), lambda k: F.contains(lower, k))
    return (F.when(c.isNull() | ~F.trim(c).rlike(rules.EMAIL_SYNTAX), F.lit("invalid format"))
            .when(placeholder, F.lit("known placeholder domain/prefix"))
            .when(local.rlike(r"^[a-z]{1,2}$"), F.lit("local part too short"))
            .when(local.rlike(rules.GIBBERISH), F.lit("gibberish local part")))


def fake_email(c: Column | str) -> Column:
    return fake_email_reason(c).isNotNull()


def _outcome(valid: bool, reason: str, score: int) -> Column:
    return F.struct(F.lit(valid).alias("valid"), F.lit(reason).alias("reason"), F.lit(score).alias("score"))


def email_score(email: Column | str, mx_count: Column | str, smtp_result: Column | str) -> Column:
    """struct(valid, reason, score) from the syntax and the supplied mail-server facts.

    `smtp_result` is 'ok', 'mailbox_not_found', any other refusal text, or NULL when unknown.
    """
    email, smtp = as_col(email), as_col(smtp_result)
    no_mx = F.coalesce(as_col(mx_count), F.lit(0)) == 0
    return (F.when(~email_valid(email), _outcome(False, "invalid_syntax", 0))
            .when(is_disposable(email), _outcome(False, "disposable_email", 20))
            .when(is_consumer(email), _outcome(True, "catch_all_domain", 80))
            .when(no_mx, _outcome(False, "no_mx_records", 30))
            .when(smtp == "ok", _outcome(True, "smtp_verified", 100))
            .when(smtp == "mailbox_not_found", _outcome(False, "mailbox_not_found", 20))
            .when(smtp.isNull(), _outcome(True, "mx_valid_smtp_unknown", 80))
            .otherwise(_outcome(False, "", 60)))


def email_score_detailed(email: Column | str, mx_count: Column | str, smtp_result: Column | str,
                         catch_all: Column | str) -> Column:
    """As email_score, with the provider type and the catch-all finding of the domain."""
    email, smtp = as_col(email), as_col(smtp_result)
    catch_all = F.coalesce(as_col(catch_all), F.lit(False))
    has_mx = F.coalesce(as_col(mx_count), F.lit(0)) > 0
    syntax = email_valid(email)
    reached = syntax & ~is_disposable(email) & has_mx
    alive = reached & ~(F.coalesce(smtp, F.lit("")) == "mailbox_not_found")
    consumer = reached & is_consumer(email)
    score = (
        F.when(syntax, 20).otherwise(0)
        + F.when(syntax & ~is_disposable(email), 10).otherwise(0)
        + F.when(reached, 20).otherwise(0)
        + F.when(alive & (smtp == "ok"), 45).when(alive & smtp.isNull() & catch_all, 5)
        .when(alive & smtp.isNull(), 20).otherwise(0)
        + F.when(alive & consumer, 5).otherwise(0)
    )
    reason = (F.when(~syntax, F.lit("invalid_syntax"))
              .when(is_disposable(email), F.lit("disposable_email"))
              .when(~has_mx, F.lit("no_mx_records"))
              .when(~alive, F.lit("mailbox_not_found"))
              .when((smtp == "ok") & catch_all, F.lit("smtp_verified_on_catch_all"))
              .when(smtp == "ok", F.lit("smtp_verified"))
              .when(catch_all, F.lit("catch_all_domain"))
              .when(smtp.isNull(), F.lit("mx_valid_smtp_unknown"))
              .otherwise(smtp))
    valid = alive & (smtp.isNull() | (smtp == "ok"))
    return F.struct(
        F.coalesce(valid, F.lit(False)).alias("valid"),
        reason.alias("reason"),
        score.alias("score"),
        F.when(consumer, F.lit("consumer")).otherwise(F.lit("business")).alias("provider_type"),
    )


# --- patterns ---------------------------------------------------------------------------------

def _substitute(pattern: Column | str, first: Column, last: Column) -> Column:
    text = F.lit(pattern) if isinstance(pattern, str) else pattern
    for token, value in (
        ("{first.last}", F.concat(first, F.lit("."), last)),
        ("{f.last}", F.concat(F.left(first, F.lit(1)), F.lit("."), last)),
        ("{first_last}", F.concat(first, F.lit("_"), last)),
        ("{first}", first),
        ("{last}", last),
        ("{f}", F.left(first, F.lit(1))),
        ("{l}", F.left(last, F.lit(1))),
    ):
        text = F.replace(text, F.lit(token), value)
    return text


def candidate_locals(first: Column, last: Column) -> Column:
    """Local parts of all usual patterns, in order: dots squeezed, an edge dot dropped."""
    patterns = F.array(*[F.lit(p) for p in rules.EMAIL_PATTERNS])
    return F.transform(patterns, lambda p: F.regexp_replace(
        F.regexp_replace(_substitute(p, first, last), r"\.+", "."), r"^\.|\.$", ""))


def email_permutations(full_name: Column | str, dom: Column | str) -> Column:
    """Array of the distinct candidate addresses of a person at a domain, most usual pattern first."""
    from .names import parse_name

    dom = as_col(dom)

    def addresses(name: Column) -> Column:
        usable = F.filter(candidate_locals(name["first"], name["last"]), lambda x: F.length(x) >= 2)
        return F.array_distinct(F.transform(usable, lambda x: F.lower(F.concat(x, F.lit("@"), dom))))

    # the parsed name is bound as a lambda variable, so it is computed once per row
    made = F.get(F.transform(F.array(parse_name(full_name)), addresses), F.lit(0))
    return F.when(as_col(full_name).isNotNull(), made)


def apply_pattern(fmt: Column | str, first: Column | str, last: Column | str, dom: Column | str,
                  missing_last: str | None = None) -> Column:
    """Address built from a company's pattern, or NULL when a part is missing or the result is malformed.

    `missing_last` replaces an absent surname ('unknown' in one of the two rules in use); by default
    no address is built then.  Built addresses are guesses and must be stored as generated.
    """
    fmt = blank_to_null(fmt)
    letters = [F.regexp_replace(F.lower(as_col(c)), "[^a-z]", "") for c in (first, last)]
    f, surname = blank_to_null(letters[0]), blank_to_null(letters[1])
    if missing_last is not None:
        surname = F.coalesce(surname, F.lit(missing_last))
    made = _substitute(fmt, f, surname)
    made = F.when(F.contains(made, F.lit("@")), made).otherwise(F.concat(made, F.lit("@"), as_col(dom)))
    return F.when(made.rlike(rules.GENERATED_SYNTAX), made)


def detect_pattern(email: Column | str, first: Column | str, last: Column | str) -> Column:
    """Pattern such as '{first}.{last}@host' behind a known address; NULL for role mailboxes."""
    local, host = local_part(email), blank_to_null(mail_domain(email))
    f = blank_to_null(F.lower(as_col(first)))
    surname = blank_to_null(F.lower(as_col(last)))

    exact = ["{first}.{last}", "{first}_{last}", "{first}{last}", "{last}.{first}", "{f}{last}",
             "{f}.{last}", "{first}.{l}", "{first}{l}", "{first}", "{last}"]
    equal = F.get(F.filter(F.array(*[F.lit(p) for p in exact]), lambda p: _substitute(p, f, surname) == local), F.lit(0))
    found = (F.when(is_generic(email) | (local == "") | host.isNull(), F.lit(None).cast("string"))
             .when(equal.isNotNull(), equal))
    found = (found.when(local.rlike(r"^[a-z]+\.[a-z]+$"), F.lit("{first}.{last}"))
             .when(local.rlike(r"^[a-z]+_[a-z]+$"), F.lit("{first}_{last}"))
             .when(local.rlike(r"^[a-z][a-z]{3,}$"), F.lit("{f}{last}")))
    return F.concat(found, F.lit("@"), host)


def fallback_pattern(email: Column | str, dom: Column | str) -> Column:
    """Coarse pattern from one address, for domains where detect_pattern found nothing."""
    local = local_part(email)
    shape = (F.when(F.contains(local, F.lit(".")), F.lit("{first}.{last}@"))
             .when(F.contains(local, F.lit("_")), F.lit("{first}_{last}@"))
             .when(local.rlike(r"^[a-z][a-z]+$") & (F.length(local) > 4), F.lit("{f}{last}@")))
    return F.concat(shape, as_col(dom))


def pattern_of(email: Column | str, dom: Column | str) -> Column:
    """Readable pattern guessed from the address alone."""
    local = local_part(email)
    shape = (F.when(F.contains(local, F.lit(".")), F.lit("first.last@"))
             .when(F.contains(local, F.lit("_")), F.lit("first_last@"))
             .when(local.rlike(r"^[a-z]{8,}$"), F.lit("firstlast@"))
             .otherwise(F.lit("firstname@")))
    return F.when((as_col(email) != "") & (as_col(dom) != ""), F.concat(shape, as_col(dom)))


def choose_email(emails: Column | str, dom: Column | str) -> Column:
    """Best address of a site: personal, then any non-role one, then hello@/info@/contact@, then any.

    Only addresses of the site's own domain count.  When there is none the answer is NULL; an
    address is never invented.
    """
    dom = as_col(dom)
    own = F.filter(as_col(emails), lambda e: F.contains(F.lower(e), F.concat(F.lit("@"), dom)))
    people = F.filter(own, lambda e: ~e.rlike(rules.SITE_GENERIC))
    personal = F.filter(people, lambda e: F.contains(local_part(e), F.lit(".")) | local_part(e).rlike(r"^[a-z]{3,}$"))

    def first_starting(prefix: str) -> Column:
        return F.get(F.filter(own, lambda e: F.startswith(F.lower(e), F.lit(prefix))), F.lit(0))

    preferred = [first_starting(p) for p in rules.PREFERRED_GENERIC]
    return F.coalesce(F.get(personal, F.lit(0)), F.get(people, F.lit(0)), *preferred, F.get(own, F.lit(0)))
