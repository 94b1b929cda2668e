from datetime import UTC, datetime

import pytest

from feedjobs.functions.dates import dates_in, event_range, find_deadline

NOW = datetime(2026, 10, 29, tzinfo=UTC)


@pytest.mark.parametrize(
    ("html", "day"),
    [
        ('<script type="application/ld+json">{"@type":"JobPosting","validThrough":"2026-12-01T00:00:00Z"}</script>', "2026-12-01T00:00:00"),
        ("<p>Application deadline: 15 January 2027</p>", "2027-01-15T23:59:59"),
        ("<p>Closing date: December 5, 2026</p>", "2026-12-05T23:59:59"),
        ("<p>Bewerbungsfrist: 15.01.2027</p>", "2027-01-15T23:59:59"),
        ("<p>Deadline 15 July</p>", "2027-07-15T23:59:59"),
        ("<p>Welcome to our department</p>", None),
        ("Deadline: 25 January 2027", "2027-01-25T23:59:59"),
        ("Deadline 5 Marketing", None),
        ("Deadline 31 February 2027", None),
        ("", None),
        (None, None),
        ("<script type='application/ld+json'>{broken</script>deadline 2027-03-01", "2027-03-01T23:59:59"),
    ],
)
def test_find_deadline(html, day):
    found = find_deadline(html, NOW)
    assert (found and found.strftime("%Y-%m-%dT%H:%M:%S")) == day


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("Held on 11-15 Jan 2027 in Tainan", "2027-01-11", "2027-01-15"),
        ("28 Jun - 3 Jul 2027", "2027-06-28", "2027-07-03"),
        ("June 3-5, 2027", "2027-06-03", "2027-06-05"),
        ("12-14 March 2019", None, None),
        ("15.-17.09.2027", "2027-09-15", "2027-09-17"),
        ("28 Dec - 3 Jan 2027", "2026-12-28", "2027-01-03"),
        ("31 February 2027", None, None),
        (None, None, None),
    ],
)
def test_event_range(text, start, end):
    got = event_range(text, NOW)
    assert (got and (str(got[0].date()), str(got[1].date()))) == (start and (start, end))


def test_order_of_patterns():
    assert [str(d.date()) for d in dates_in("2027-02-01 or 15.01.2027 or 3 May", NOW)] == ["2027-01-15", "2027-02-01", "2027-05-03"]
