import base64
import json

from helpers import values
from postsieve.plans.mail import enriched_mail
from postsieve.sources.mail import mail_candidates, mail_postings, mime_bodies

JOB = "https://www.linkedin.com/comm/jobs/view/%d?trk=x"


def coded(text):
    return base64.urlsafe_b64encode(text.encode()).decode()


def part(mime, text=None, parts=()):
    return {"mimeType": mime, "body": {"data": coded(text)} if text is not None else {}, "parts": list(parts)}


def messages(spark, *payloads):
    rows = [(f"m{i}", i, json.dumps(p) if not isinstance(p, str) else p) for i, p in enumerate(payloads)]
    return values(spark, "msg_id string, msg_seq long, payload string", rows)


def found(spark, *payloads):
    got = mail_postings(messages(spark, *payloads)).orderBy("pos").collect()
    return [(r.title, r.company, r.url) for r in got]


def html(body):
    return part("multipart/alternative", parts=[part("text/plain", "Title here\nhttps://www.linkedin.com/jobs/view/9"), part("text/html", f"<html>{body}</html>")])


def test_bodies_come_in_order_of_the_tree(spark):
    tree = part("multipart/mixed", parts=[
        part("multipart/alternative", parts=[part("text/plain", "one"), part("text/html", "<p>two")]),
        part("image/png", "no"), part("text/plain", "three"),
    ])
    tree["parts"].insert(1, {"mimeType": "text/plain", "body": {"data": "AAAAA"}})
    got = messages(spark, tree, "not json", part("text/plain", "top")).select(mime_bodies("payload").alias("b")).collect()
    assert [[(p.mime, p.body) for p in r.b] for r in got] == [
        [("text/plain", "one"), ("text/html", "<p>two"), ("text/plain", "three")], [], [("text/plain", "top")],
    ]


def test_shorter_anchor_text_wins_and_company_is_near(spark):
    body = (
        f'<table><tr><td><a href="{JOB % 4000001}">Creative Director Acme Toronto</a></td></tr><tr><td>'
        f'<a href="{JOB % 4000001}"><h3>Creative Director</h3></a><p>Creative Director</p><span> Acme <b>Co</b></span></td></tr></table>'
    )
    assert found(spark, html(body)) == [("Creative Director", "AcmeCo", "https://www.linkedin.com/comm/jobs/view/4000001")]


def test_scaffolding_places_and_foreign_links_are_no_postings(spark):
    body = "".join(
        f'<a href="{href}">{text}</a>'
        for href, text in [
            (JOB % 1, "Easy Apply"), (JOB % 1, "Toronto, Ontario"), (JOB % 1, "abc"), ("https://other.com/jobs/view/1", "Creative Director"),
            ("https://www.linkedin.com/feed", "Feed of postings"), (JOB % 4000002, "Head of Brand"),
        ]
    )
    assert found(spark, html(body)) == [("Head of Brand", "", "https://www.linkedin.com/comm/jobs/view/4000002")]


def test_current_job_id_is_rebuilt(spark):
    body = '<div><a href="https://www.linkedin.com/comm/jobs/search?x=1&amp;currentJobId=55">Art Director</a></div>'
    assert found(spark, html(body)) == [("Art Director", "", "https://www.linkedin.com/jobs/view/55/")]


def test_loose_anchors_only_without_posting_anchors(spark):
    loose = '<a href="https://www.linkedin.com/e/1?a=2">Narrative Director, Games</a><a href="https://li.com/2">Unsubscribe creative lead</a>'
    assert found(spark, html(loose)) == [("Narrative Director, Games", "", "https://www.linkedin.com/e/1?a=2")]
    both = loose + f'<a href="{JOB % 7}">Plain title</a>'
    assert found(spark, html(both)) == [("Plain title", "", "https://www.linkedin.com/comm/jobs/view/7")]


def test_plain_lines(spark):
    text = "Acme\r\n  Head of Content \r\nView: https://www.linkedin.com/jobs/view/12?x=1 now\nSee all\nhttps://www.linkedin.com/jobs/view/13\nabc\nhttps://www.linkedin.com/jobs/view/14"
    first_line = "https://www.linkedin.com/jobs/view/15"
    assert found(spark, part("text/plain", text), part("text/plain", first_line)) == [
        ("Head of Content", "Acme", "https://www.linkedin.com/jobs/view/12")
    ]


def test_html_body_without_anchors_is_read_as_lines(spark):
    body = "<p>x</p>\nA long title\nhttps://www.linkedin.com/jobs/view/21\n"
    assert found(spark, html(body)) == [("A long title", "<html><p>x</p>", "https://www.linkedin.com/jobs/view/21")]


def test_one_strategy_per_message(spark):
    rows = mail_candidates(messages(
        spark, html(f'<a href="{JOB % 1}">One title</a>'), part("text/plain", "Two title\nhttps://www.linkedin.com/jobs/view/2"), part("text/plain", "")
    )).collect()
    assert sorted((r.msg_id, r.strategy) for r in rows) == [("m0", 1), ("m1", 3)]


def test_first_message_wins_and_details_are_joined(spark):
    def mail(title):
        return html(f'<a href="{JOB % 4000005}">{title}</a>')

    details = values(spark, "external_id string, detail string", [("4000005", "full text"), ("1", "other")])
    got = enriched_mail(messages(spark, mail("A longer title"), mail("Short")), details).collect()
    assert [(r.title, r.description, r.batch_seq, r.source) for r in got] == [("A longer title", "full text", 1, "LinkedIn")]
