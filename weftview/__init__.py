"""weftview: web-page views as Spark DataFrame operators.

Pages are tokenised into a relation once (one shuffle by ``page_id``); scopes,
main content, noise removal, markdown, links and navigation state are window,
aggregate and join plans over that relation.
"""

__version__ = "0.1.0"
