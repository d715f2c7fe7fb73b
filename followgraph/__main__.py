"""Command line: see ``followgraph.jobs``."""

import sys

from pyspark.sql import SparkSession

from followgraph.jobs import parser, run

if __name__ == "__main__":
    parser().parse_args()
    session = SparkSession.builder.appName("followgraph").getOrCreate()
    try:
        run(session, sys.argv[1:])
    finally:
        session.stop()
