"""turnlake: Spark DataFrame operators for timed, speaker-attributed text.

Every public operator takes and returns Spark DataFrames; nothing is collected
to the driver.  Times are BIGINT milliseconds, ``episode_id`` keys a recording.
"""

from __future__ import annotations

__version__ = "0.1.0"
