"""orderloom: market-by-order analytics as Spark DataFrame jobs.

Public functions take DataFrames and return DataFrames, lazily; the one probe
that runs while a plan is built is the search for hot order ids
(``operators.orders.order_log``).  The session key of the whole library is
``KEY = (instrument_id, trade_date)`` and the only total order is ``ordinal``.
"""
