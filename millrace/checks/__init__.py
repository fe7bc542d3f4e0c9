"""Rule checks over repositories' trees and files."""
