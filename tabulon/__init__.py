"""tabulon: Spark-native data work around a tabular classification model.

Every operator is a function from DataFrames to DataFrames, driven by column
roles (``tabulon.roles.ColumnRoles``) rather than fixed column names.
"""

from tabulon.roles import ColumnRoles
from tabulon.session import get_session, checkpoint_dir

__all__ = ["ColumnRoles", "get_session", "checkpoint_dir"]
