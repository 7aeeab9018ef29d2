"""Parameters of the registered driver queries.

The driver data span 30 days from 2024-01-01; readings are far sparser than
the real 5-120 s cadences, so the registered queries pass a one-day gap limit
(the reference defaults stay the function defaults, covered by the tests).
"""

START = "2024-01-01 00:00:00"
END = "2024-01-31 00:00:00"
NOW = "2024-01-31 00:00:00"
MAX_GAP = 86400.0
ROUND = 6
