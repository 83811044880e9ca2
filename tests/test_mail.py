from datetime import datetime, timedelta

import pytest

from tickettide.operators import mail

NOW = datetime(2026, 3, 1, 12)
SCHEMA = "folder string, subject string, sender string, received timestamp_ntz, attachments array<string>"


def message(*attachments, subject="Monthly Report", days=1, folder="Inbox", sender="alice"):
    return (folder, subject, sender, NOW - timedelta(days=days), list(attachments))


@pytest.fixture
def scan(spark):
    def run(*messages, **options):
        staged = mail.scan(spark.createDataFrame(list(messages), SCHEMA), "", NOW, **options)
        found = sorted(tuple(r) for r in mail.found_attachments(staged).collect())
        return found, mail.scan_diagnostics(staged, "", NOW).first(), mail.scan_errors(staged).collect()
    return run


def test_a_spreadsheet_is_found(scan):
    found, counts, errors = scan(message("report.xlsx"))
    assert found == [("Monthly Report", "alice", "2026-02-28 12:00:00", "report.xlsx")]
    assert (counts.in_date_range, counts.excel_attachments_found, errors) == (1, 1, [])
    assert (counts.folder_name, counts.date_from, counts.date_to) == (
        "Inbox", "2026-01-30 12:00", "2026-03-01 12:00")


def test_other_files_are_skipped(scan):
    found, counts, _ = scan(message("invoice.pdf", "Budget.XLS", "no_extension"))
    assert [f[3] for f in found] == ["Budget.XLS"]
    assert (counts.skipped_non_excel, counts.excel_attachments_found) == (2, 1)


def test_old_messages_are_skipped(scan):
    found, counts, _ = scan(message("a.xlsx", days=60), days_back=30)
    assert (found, counts.skipped_too_old, counts.in_date_range) == ([], 1, 0)
    assert scan(message("a.xlsx", days=30))[1].in_date_range == 1


def test_subject_filter_ignores_case(scan):
    found, counts, _ = scan(message("budget.xlsx", subject="Q1 Budget"), message("o.xlsx", subject="Meeting Notes"),
                            message("n.xlsx", subject=None), subject_filter="budget")
    assert [f[3] for f in found] == ["budget.xlsx"] and counts.skipped_subject_filter == 2


def test_each_message_leaves_at_its_first_stage(scan):
    unreadable = ("Inbox", "s", None, NOW, None)
    no_mail = ("Inbox", None, None, None, ["x.xlsx"])
    found, counts, errors = scan(
        message(), message("a.xlsx"), message("b.pdf", subject="other"), unreadable, no_mail,
        message(days=90), subject_filter="report")
    assert len(found) == 1
    assert (counts.total_items, counts.skipped_non_mail, counts.skipped_too_old, counts.in_date_range) == (6, 1, 1, 4)
    assert (counts.skipped_no_attachment, counts.skipped_subject_filter, counts.error_count) == (1, 1, 2)
    assert sorted(e.error for e in errors) == [
        "[2026-03-01 12:00:00] attachments could not be read", "[non-mail item] no received time"]


def test_folders(spark):
    mails = spark.createDataFrame([message("a.xlsx", folder="Reports"), message(folder="Inbox")], SCHEMA)
    assert mail.folder_messages(mails, " reports ").count() == 1
    assert mail.folder_messages(mails).first().folder == "Inbox"
    mail.require_folder(mails, "REPORTS")
    mail.require_folder(mails, "")
    assert sorted(r.folder for r in mail.folder_names(mails).collect()) == ["Inbox", "Reports"]
    counts = mail.scan_diagnostics(mail.scan(mails, "reports", NOW), "reports", NOW).first()
    assert (counts.folder_name, counts.total_items) == ("Reports", 1)
    with pytest.raises(ValueError, match="'DoesNotExist'"):
        mail.require_folder(mails, "DoesNotExist")
