"""assetsweep: keep large collections of files and documents clean, on Spark.

Inventory assets, find exact content duplicates without shuffling payloads,
choose a keeper per group, plan and re-verify the removal of the rest,
archive with an undoable manifest, catalogue model-file headers and estimate
which models fit which machines.  Every step is a DataFrame job.
"""

from assetsweep.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
