"""Rules read from scripts."""

import pytest

from pressmill.operators import extract as E
from pressmill.operators import rules as R
from pressmill.plans import catalog
from pressmill.sources import rule_objects as O

SCRIPT = r"""
// a rule, with code that is passed over
import cheerio from 'cheerio';
const helper = $node => { const a = /["'{]/.test($node.text()); return a ? '}' : `{`; };
export const ExampleOrgExtractor = {
  domain: 'example.org',
  supportedDomains: ['www.example.net', "other.example.com",],
  title: { selectors: ['h1.head', ['meta[name="og:title"]', 'value']] },
  author: 'It\'s Ann',
  date_published: { selectors: [['time[datetime]', 'datetime', x => x.split(')')[0]]], timezone: 'Asia/Tokyo', format: 'YYYY-MM-DD' },
  dek: null, /* nothing */
  lead_image_url: { selectors: [['meta[name="og:image"]', 'value']] },
  content: {
    selectors: [['.lead', '.story'], '.story'],
    defaultCleaner: false,
    transforms: {
      h5: 'h2',
      'div.x': ($node, $) => { if ($node.find('p').length / 2 > 1) { return 'p'; } return null; },
      noscript(node) { return /}/.test(node) ? 'div' : null; },
    },
    clean: ['.ad' + '.big'],
  },
  extend: { tags: { selectors: ['a.tag'], allowMultiple: true }, score: { selectors: [['.score', 'data-score']] } },
  ...more,
};
export default { name: 'no rule' };
"""


def test_a_script_becomes_rules():
    (rule,) = O.rules_of(SCRIPT)
    assert rule == {
        "domain": "example.org",
        "aliases": ["www.example.net", "other.example.com"],
        "title": ["h1.head", {"select": 'meta[name="og:title"]', "attr": "value"}],
        "author": {"value": "It's Ann"},
        "date_published": {"selectors": [{"select": "time[datetime]", "attr": "datetime"}], "timezone": "Asia/Tokyo", "format": "YYYY-MM-DD"},
        "lead_image_url": [{"select": 'meta[name="og:image"]', "attr": "value"}],
        "content": {
            "selectors": [{"all": [".lead", ".story"]}, ".story"],
            "clean": [".ad.big"],
            "default_cleaner": False,
            "transforms": [["h5", {"tag": "h2"}], ["div.x", {"named": "example.org::div.x"}], ["noscript", {"named": "example.org::noscript"}]],
        },
        "extend": {"tags": {"selectors": ["a.tag"], "allow_multiple": True}, "score": {"selectors": [{"select": ".score", "attr": "data-score"}]}},
    }


def test_written_rules_are_used(spark, tmp_path):
    (tmp_path / "site").mkdir()
    plain = SCRIPT.replace("'div.x': ($node", "'h6': 'h3', skipped: ($node").replace("noscript(node)", "other(node)")
    (tmp_path / "site/index.js").write_text(plain)
    assert O.write_rules(tmp_path / "rules.json", [tmp_path / "site"]) == 1
    (rule,) = R.load_rules(tmp_path / "rules.json")
    with pytest.raises(ValueError, match="no such change"):
        R.check_rule(rule)
    rule["content"]["transforms"] = [t for t in rule["content"]["transforms"] if "tag" in t[1]]
    page = '<h1 class="head">Head</h1><div class="lead"><p>Lead.</p></div><div class="story"><h5>Part</h5><p>Story.</p></div><a class="tag">x</a><time datetime="2020-01-02">'
    frame = spark.createDataFrame([(1, "https://www.example.net/a", page)], "page_id long, url string, html string")
    r = E.extract_articles(frame, E.Options(now=catalog.NOW, rules=(rule,), fallback=False)).first()
    assert (r.title, r.author, r.date_published) == ("Head", "It's Ann", "2020-01-01T15:00:00.000Z")
    assert "Lead." in r.content and "Story." in r.content and r.extend["tags"] == '["x"]'


@pytest.mark.parametrize("text", ["x = {domain: 'a'", "x = {domain 'a'}", "x = [ 'a' 'b' ]; y = {a: [1 2}"])
def test_broken_scripts_are_told(text):
    with pytest.raises(ValueError):
        O.rules_of(text)


def test_scripts_without_rules():
    assert O.rules_of("") == [] and O.rules_of("const a = {b: 1}; function f() { return {domain: 'x'} }") == []
