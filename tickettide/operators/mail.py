"""Attachment scan: a staged filter over message metadata.

Messages are rows of ``folder, subject, sender, received timestamp_ntz,
attachments array<string>``. A message is counted at the first stage it fails.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickettide.functions.text import file_extension
from tickettide.functions.times import as_time, minute_text, second_text, shift_days, to_second

# Attachments taken for spreadsheets.
SPREADSHEET_EXTENSIONS = (".xlsx", ".xls")

DEFAULT_DAYS_BACK = 30
INBOX = "Inbox"

NOT_MAIL = "non_mail"
TOO_OLD = "too_old"
UNREADABLE = "unreadable"
NO_ATTACHMENT = "no_attachment"
OTHER_SUBJECT = "subject_mismatch"
PASSED = "passed"


def folder_messages(messages: DataFrame, name: str = "") -> DataFrame:
    """Messages of one folder, looked up ignoring case; of the inbox without a name."""
    wanted = name.strip() or INBOX
    return messages.filter(F.lower("folder") == wanted.lower())


def folder_names(messages: DataFrame) -> DataFrame:
    """The folders there are, however many."""
    return messages.select("folder").distinct()


def require_folder(messages: DataFrame, name: str) -> None:
    """Raise a `ValueError` if no message is in a folder of this name; `folder_names` has those there are."""
    if name.strip() and folder_messages(messages, name).isEmpty():
        raise ValueError(f"no folder named {name.strip()!r}")


def with_stage(
    messages: DataFrame,
    as_of: Column | datetime | date | str | None = None,
    days_back: int = DEFAULT_DAYS_BACK,
    subject_filter: str = "",
) -> DataFrame:
    """Messages with the stage at which each one leaves the scan; `scan` takes those of one folder."""
    cutoff = shift_days(as_time(as_of), -days_back)
    received = to_second(F.col("received"))
    subject = F.coalesce("subject", F.lit(""))
    stage = (
        F.when(F.col("received").isNull(), NOT_MAIL)
        .when(received < cutoff, TOO_OLD)
        .when(F.col("attachments").isNull(), UNREADABLE)
        .when(F.size("attachments") == 0, NO_ATTACHMENT)
    )
    if subject_filter:
        stage = stage.when(
            ~F.lower(subject).contains(subject_filter.lower()), OTHER_SUBJECT
        )
    return messages.withColumns({
        "received": received,
        "subject": subject,
        "sender": F.coalesce("sender", F.lit("")),
        "stage": stage.otherwise(PASSED),
    })


def scan(
    messages: DataFrame,
    folder: str = "",
    as_of: Column | datetime | date | str | None = None,
    days_back: int = DEFAULT_DAYS_BACK,
    subject_filter: str = "",
) -> DataFrame:
    """The messages of one folder, the inbox without a name, with their stages."""
    return with_stage(folder_messages(messages, folder), as_of, days_back, subject_filter)


def _is_spreadsheet(filename: Column) -> Column:
    return file_extension(filename).isin(*SPREADSHEET_EXTENSIONS)


def found_attachments(staged: DataFrame) -> DataFrame:
    """One row per spreadsheet attached to a message that passed all stages."""
    return (
        staged.filter(F.col("stage") == PASSED)
        .select(
            "subject",
            "sender",
            second_text(F.col("received")).alias("received"),
            F.explode("attachments").alias("filename"),
        )
        .filter(_is_spreadsheet(F.col("filename")))
    )


def scan_diagnostics(
    staged: DataFrame,
    folder: str = "",
    as_of: Column | datetime | date | str | None = None,
    days_back: int = DEFAULT_DAYS_BACK,
) -> DataFrame:
    """One row of counts per stage of a folder's scan; two count attachments, not messages.

    The folder is named as its messages name it, as asked for where there are none.
    """
    now = as_time(as_of)

    def messages_at(*stages: str) -> Column:
        return F.count_if(F.col("stage").isin(*stages))

    attached = F.when(F.col("stage") == PASSED, F.col("attachments"))
    spreadsheets = F.size(F.filter(attached, _is_spreadsheet))
    size = F.size(attached)
    return staged.select(
        "stage",
        "folder",
        F.when(attached.isNotNull(), size - spreadsheets).alias("others"),
        F.when(attached.isNotNull(), spreadsheets).alias("spreadsheets"),
    ).agg(
        F.coalesce(F.min("folder"), F.lit(folder.strip() or INBOX)).alias("folder_name"),
        minute_text(shift_days(now, -days_back)).alias("date_from"),
        minute_text(now).alias("date_to"),
        F.count(F.lit(1)).alias("total_items"),
        messages_at(NOT_MAIL).alias("skipped_non_mail"),
        messages_at(TOO_OLD).alias("skipped_too_old"),
        messages_at(UNREADABLE, NO_ATTACHMENT, OTHER_SUBJECT, PASSED).alias("in_date_range"),
        messages_at(NO_ATTACHMENT).alias("skipped_no_attachment"),
        messages_at(OTHER_SUBJECT).alias("skipped_subject_filter"),
        F.coalesce(F.sum("others"), F.lit(0)).alias("skipped_non_excel"),
        F.coalesce(F.sum("spreadsheets"), F.lit(0)).alias("excel_attachments_found"),
        messages_at(NOT_MAIL, UNREADABLE).alias("error_count"),
    )


def scan_errors(staged: DataFrame) -> DataFrame:
    """One row per message that could not be read.

    A table and not a list within the counts: a list of all errors would have
    to fit into one row.
    """
    # How an error begins.
    text = F.when(F.col("stage") == NOT_MAIL, F.lit("[non-mail item] no received time")).when(
        F.col("stage") == UNREADABLE,
        F.concat(
            F.lit("["),
            second_text(F.col("received")),
            F.lit("] attachments could not be read"),
        ),
    )
    return staged.select("subject", "sender", text.alias("error")).filter(
        F.col("error").isNotNull()
    )
