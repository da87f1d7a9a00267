"""Short texts of our own wording that trigger the rules, each beside one that must not."""

TEXTS: list[tuple[int, str]] = [
    (-1, "We delve into the robust landscape.\nThe leverage was financial leverage; they leverage it — badly.\n\nHe said 6,000 of them, or 6k, came. Robust again! \"Really?\" she asked. Dr. Smith didn't mind."),
    (-2, "Moreover, it is important to note that the plan works. Furthermore, experts believe the future is bright.\nIn conclusion, we navigate a transformative journey (nothing short of pivotal)."),
    (-3, "# Notes\n\n- First item here.\n- Second item there.\n> quoted words stay in place.\n\n```\ncode; is; not; prose\n```\n\n    indented code line\n\nA plain paragraph, with commas, and `ticks`. It has two sentences."),
    (-4, ""),
    (-5, "JANE ROE\njane.roe@example.org | (555) 010-2000 | github.com/janeroe\n\nEXPERIENCE\nLead Engineer, Acme   Jan 2019 - Mar 2022\n• Built 12 services for 300 customers and cut costs by 17%\n• Led a team of 8 engineers across two\n  offices and three time zones\n• Wrote the runbook, the tests, and the alerts\n\nJunior Engineer, Zenith   Jun 2015 - Dec 2018\n• Ran 40 migrations in 9 weeks\n• Shipped the billing module to 1,200 users\n\nEDUCATION\nBSc, State College\n\nSKILLS\nPython, SQL, Go"),
    (-6, "Profile of a team player\nResponsible for many things in the office and beyond it\nWorked on the system and helped with the reports every day\nI manage my own projects and built my own tools here\nDrove significant growth, synergy, and results for all the stakeholders\nStreamlined processes, optimized workflows, and facilitated cross-functional meetings often"),
    (-7, "SUMMARY\n* Spearheaded change, growth, and value for 20% of the firm daily\n* Leveraged tools, people, and plans for 25% of the firm daily\n* Championed goals, norms, and aims for 40% of the firm daily\n* Orchestrated teams, tasks, and time for 15% of the firm daily\n* Pioneered ideas, forms, and ways for 10% of the firm daily\n* Managed the rest of it all alone in the office for years"),
    (-8, "Café owners and naïve résumé writers can't agree; it's odd. They'd rather wait. Thus the talks go on and on, and nobody at scale is worth noting."),
]


def values_sql() -> str:
    """The texts as a DuckDB VALUES list of (doc_id, text)."""
    return ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in TEXTS)
